"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import tiktoken
import xxhash
from compare import compare, duck

import corpus_pipeline
from tidepanel.llm import bpe, components, langid, mixing, repeats, simhash, syncmers, wrapper
from tidepanel.llm.queries import QUERIES, SQL, tokenizer_files
from tidepanel.llm.suffixes import suffix_arrays

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), sf, QUERIES[name], SQL[name]).startswith("ok")


def test_suffix_arrays():
    random.seed(3)
    for _ in range(60):
        lanes = [[random.randint(1, random.choice([1, 2, 9])) for _ in range(random.randint(0, 50))] * random.choice([1, 3]) + [0] for _ in range(4)]
        start = np.cumsum([0] + [len(x) for x in lanes])
        got = suffix_arrays(np.concatenate(lanes), start)
        for k, lane in enumerate(lanes):
            assert (got[start[k] : start[k + 1]] - start[k]).tolist() == sorted(range(len(lane)), key=lambda i: lane[i:])


def covered(texts: list[str]) -> list[list[tuple[int, int]]]:
    n = repeats.LENGTH
    raw = [t.encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        out.append([m.span() for m in re.finditer(b"\1+", bytes(mark))])
    return out


def test_repeats_of_a_very_common_passage(spark, monkeypatch):
    """One passage in most texts, so that its anchors are split over lanes; near and exact copies and periodic text."""
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    line = lambda n: " ".join(word() for _ in range(n))
    common, base = line(60), line(200)
    texts = [line(30) + common[random.randint(0, 40) :] + line(30) for _ in range(150)] + [base] * 5
    texts += [base[:600] + word() + base[606:] for _ in range(5)] + ["a" * 1000, "ab" * 300, "é" * 150, line(100), base[:199], base[:200]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = covered(texts)
    for r in repeats.cut_repeats(df).collect():
        assert [(s["start"], s["stop"]) for s in r["spans"]] == want[r["row"]["doc_id"]], r["row"]["doc_id"]


@needs_tables
def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    for doc_id, text, spans in zip(docs.doc_id, docs.text, covered(docs.text.tolist())):
        raw = text.encode()
        edges = [0, *(x for s in spans for x in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert tuple(got[doc_id])[1:] == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def simhash_of(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: list[int]) -> list[int]:
    """Least place that links of at most two bits reach."""
    root = list(range(len(fps)))
    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = sorted((root[i], root[j]))
            if a != b:
                root = [a if r == b else r for r in root]
    return root


@needs_tables
def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, SF).collect()}
    fps = [simhash_of(t) for t in docs.text]
    ids = docs.doc_id.tolist()
    for doc_id, fp, root in zip(ids, fps, linked(fps)):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{fp:016x}", ids[root])


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_near_links_of_dense_and_sparse_fingerprints(spark, bucket):
    """All links are found whether buckets are cut once or three times."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 1 << 63}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.near_links(df, bucket=bucket)).collect()}
    root = linked(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    groups = Counter(root)
    mine = Counter(found.get(x, x) for x in signed)
    assert sorted(groups.values()) == sorted(mine.values())
    for i, x in enumerate(signed):
        assert found.get(x, x) == min(signed[j] for j in range(len(fps)) if root[j] == root[i])


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)} or got == {i: 100 for i in range(101, 161)} | {i: 1 for i in range(2, 60)}


@needs_tables
def test_op10(spark, docs):
    path, pattern = tokenizer_files()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, SF).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = exact(text)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want
    random.seed(2)
    odd = ["", " ", "\n\n  a", "it's we'll", "a" * 3000, "日本語" * 200, "\x1c\x1d a\x1f", "".join(random.choices("abé 日0'\n", k=3000)), "!?" * 900]
    offsets, flat = bpe.tokenizer(path, pattern).encode(odd)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [exact(t) for t in odd]


def test_forward_backward():
    rng = np.random.default_rng(0)
    k, lens = 3, np.array([0, 5, 130, 64, 1])
    weight, switch = rng.random((lens.sum(), k)), rng.random((k, k))
    gamma, _, _ = langid.forward_backward(weight, lens, switch)
    flat, at = gamma.reshape(-1, k)[langid._cells(lens)], 0
    for n in lens:
        e = weight[at : at + n]
        ahead, behind = [], [np.ones(k)]
        for t in range(n):
            now = ((np.full(k, 1 / k) if t == 0 else ahead[-1]) @ switch) * e[t]
            ahead.append(now / now.sum())
        for t in range(n - 1, 0, -1):
            now = switch @ (e[t] * behind[0])
            behind.insert(0, now / now.sum())
        if n:
            want = np.array(ahead) * np.array(behind)
            assert np.abs(want / want.sum(1, keepdims=True) - flat[at : at + n]).max() < 1e-5
        at += n


def test_words_of_a_switching_text():
    en, de = "the house and the garden were old and green", "das haus und der garten waren alt und grün"
    chain = langid.train([("en", en)] * 20 + [("de", de)] * 20)
    number, expected = chain.expected([en + ". " + de, en, "123 !!", None])
    assert number.tolist() == [18, 9, 0, 0]
    assert np.abs(expected[0] - 9).max() < 1.5 and expected[1].argmax() == chain.labels.index("en")


@needs_tables
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    named = QUERIES["op4_language"](spark, sf).join(docs, "doc_id").filter("held_out").toPandas()
    assert (named.lang == named.lang_pred).mean() > 0.99
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marked = QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert marked[marked.toxic == 1].predicted.mean() > 0.7 and marked[marked.toxic == 0].predicted.mean() < 0.02
    assert (marked.predicted == (marked.score >= 0.7)).all()


@needs_tables
def test_op2(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op2_licences"](spark, SF).collect()}
    marks = {"apache": "under the apache license", "mit": "the mit license", "gpl": "gnu general public", "cc": "under cc by", "all-rights-reserved": "all rights reserved"}
    for doc_id, text in zip(docs.doc_id, docs.text):
        assert rows[doc_id]["families"] == ",".join(sorted(f for f, m in marks.items() if m in text.lower()))
        assert rows[doc_id]["n_paragraphs"] == text.count("\n") + 1


@needs_tables
def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, SF).collect()}
    texts, ids = docs.text.tolist(), docs.doc_id.tolist()
    near = []
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        q, following = len(text) // 4, texts[(i + 1) % len(texts)]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest())
        assert r["near_next"] == pytest.approx(_jaccard(r["fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(_jaccard(r["fingerprint"], r["edited_fingerprint"]))
        near.append(r["near_edited"])
    assert np.median(near) > 0.5


def _jaccard(a: str, b: str) -> float:
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_anchors_do_not_depend_on_what_stands_around(spark):
    random.seed(4)
    words = lambda n: " ".join("".join(random.choices("abcdefghij", k=random.randint(1, 20))) for _ in range(n))
    passage = words(300)
    df = spark.createDataFrame([(passage,), (words(50) + " " + passage + " " + words(50),)], "text string")
    inner, outer = (r["a"] for r in syncmers.with_anchors(df, "text", "a").collect())
    assert 0.3 < len(inner) / len(re.findall(r"\S{1,8}", passage)) < 0.55
    at = outer.index(inner[0])
    assert outer[at : at + len(inner)] == inner


def test_apportioned_seats(spark):
    random.seed(6)
    for seats in (0, 1, 7, 1000):
        votes = [random.choice([0, 1, 5, random.random() * 1000]) for _ in range(random.randint(1, 30))]
        df = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, i int, v double, s long")
        got = [r["out"] for r in mixing.apportion(df, ["g"], ["i"], "v", "s", "out").orderBy("i").collect()]
        want = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[k] += 1
        assert got == want


def test_wrapper_learns_what_is_constant(spark):
    page = "<div class=x><p>Welcome to our site</p></div><div class=y><h2>Title {0}</h2><p>Story {0} one</p><p>Story {0} two</p></div><div class=z>Made by us</div>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    for r in wrapper.main_text(df).collect():
        i = r["row"]["page_id"]
        assert r["text"] == f"Title {i}\n\nStory {i} one\n\nStory {i} two"


def test_tree_matching():
    a, b = (wrapper.parse(x) for x in ("<div><h1>a</h1><p>b</p></div><ul><li>c</ul>", "<ul><li>d</ul><div><h1>e</h1><table><tr><td>f</table><p>g</p></div>"))
    pairs = wrapper.align(a, b)
    assert ("a", "e") in {(x.text, y.text) for x, y in pairs} and ("b", "g") in {(x.text, y.text) for x, y in pairs} and ("c", "d") not in {(x.text, y.text) for x, y in pairs}


def similar(texts: list[str]) -> set[int]:
    """Least place of each group that a Jaccard similarity of 0.8 of sets of five-word shingles links, all pairs tried."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()} for w in words]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


@needs_tables
def test_pipeline(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(r["doc_id"] for r in stages["language"](spark, df, SF).collect()) == {i for i, t in zip(docs.doc_id, docs.text) if any(c.isalpha() for c in t)}
    norm = docs.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]", "", t))
    best = docs.assign(norm=norm, n=-docs.text.str.len()).sort_values(["n", "doc_id"]).drop_duplicates("norm")
    assert {r["doc_id"] for r in stages["exact"](spark, df, SF).collect()} == set(best.doc_id)
    assert {r["doc_id"] for r in stages["near"](spark, df, SF).collect()} == {docs.doc_id.iloc[k] for k in similar(docs.text.tolist())}
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("not round_trip").count() == 0
