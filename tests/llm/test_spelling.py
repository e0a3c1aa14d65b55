"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from tidepanel.llm import spelling
from tidepanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def edits(word: str, letters: str) -> set[str]:
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute(counts: dict[str, int], pairs) -> set[tuple]:
    form, out = {}, set()
    n_near = {}
    for w, n in counts.items():
        around = pairs(w)
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts.get(form[w])))
    return out


def rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 6), (2, "abé", 4), (3, "aß😀", 4)])
def test_all_pairs(spark, seed, letters, longest):
    random.seed(seed)
    words = {"".join(random.choice(letters) for _ in range(random.randint(1, longest))) for _ in range(120)}
    counts = {w: random.choice([1, 2, 3, 5, 8, 20, 40, 80, 400]) for w in words}
    expected = brute(counts, lambda w: [v for v in counts if near(v, w)])
    got = rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)))
    assert len(got) == len(expected) and set(got) == expected


def test_long_words_by_digest(spark):
    base = ["é" * 60 + "x" * 500, "abc" * 400, "q" * 47, "q" * 48, "q" * 49, "r" * 23 + "é" + "s" * 23]
    words = set(base)
    for w in base:
        words |= {w[:100] + "z" + w[100:], w[:7] + "y" + w[8:], w + "z", w[1:], w[:-1] + "k", w[:30] + "k" + w[31:40] + "k" + w[41:]}
    counts = {w: 3 ** (i % 4) for i, w in enumerate(sorted(words))}
    expected = brute(counts, lambda w: [v for v in counts if near(v, w)])
    assert set(rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))) == expected


def test_a_chain_of_forms(spark):
    counts = {"a" * i: 2**i for i in range(1, 12)}
    got = {r[0]: r for r in rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert all(r[2] == "a" * 11 for r in got.values()) and got["a" * 11][1] is None


def test_edge_rows(spark):
    table = [("word", 1, "x"), ("word", 2, "x"), (None, 9, "x"), ("wordy", None, "x"), ("words", 0, "x"), ("", 4, "x"), ("wird", 2, "x")]
    got = rows(spelling.variants(spark.createDataFrame(table, "word string, n long, root string")))
    assert set(got) == {("word", None, "word", 3, 1, None), ("wird", None, "wird", 2, 1, None), ("", None, "", 4, 0, None)} and len(got) == 3
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    docs = [(1, "Größe GRÖßE größe", "w"), (1, "Größe GRÖßE größe", "w"), (2, None, "w"), (None, "tiny öäüßé", "w"), (3, "", "w"), (4, "z" * 200_000 + " b", "w")]
    counts = spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string, word string"))
    assert {r["word"]: r["n"] for r in counts.collect()} == {"größe": 4, "grÖße": 2, "öäüßé": 1, "z" * 200_000: 1}
    with pytest.raises(ValueError):
        spelling.variants(none, 1)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
def test_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = "".join(sorted({c for w in counts for c in w}))
    expected = brute(counts, lambda w: [v for v in edits(w, letters) if v in counts])
    got = rows(QUERIES["op13_spelling"](spark, SF))
    assert len(got) == len(expected) and set(got) == expected
    assert any(r[4] for r in got) and any(r[1] for r in got)
