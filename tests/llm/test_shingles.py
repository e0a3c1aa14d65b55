"""Near copies against brute force."""

import random

import pyarrow as pa

import corpus_pipeline
from tidepanel.llm import shingles


def shingle_set(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_all_near_copies_are_linked(spark):
    """Copies with a few changed words, far more than two bits of a fingerprint apart, a large group, a common line."""
    rng = random.Random(7)
    line = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    common, texts = line(12), []
    for size in (8, 30, 60, 200, 200):
        base = line(size)
        for _ in range(40 if size == 60 else 6):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + size // 40)):
                copy[rng.randrange(size)] = line(1)[0]
            texts.append(" ".join(copy + line(rng.randint(0, 3))))
    texts += [" ".join(common + line(rng.randint(0, 30))) for _ in range(40)] + ["", "a", "A  b", "a B"]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["row"]["doc_id"]: (r["component_id"], r["kept"]) for r in shingles.near_copies(df).collect()}
    assert got == {i: (r, i == r) for i, r in enumerate(root)}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()} == set(root)


def test_unlike_sets_of_a_bucket_are_not_paired(spark):
    """A bucket of sets that share little hands on no pairs, so its pairs do not grow with its square; like ones are kept."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(300)]
    like = [t.split() for t in texts[:40]]
    for k, w in enumerate(like):
        w[0 if k % 2 else -1] = word()
    texts += [" ".join(w) for w in like]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    made = {r["i"]: r for r in shingles._with_nodes(rows, 5).collect()}
    bucket = sorted((1, made[i]["node"], made[i]["n"], made[i]["node"], *(made[i][c] for c in shingles.SHORT)) for i in made)
    bucket.sort(key=lambda r: (r[2], r[1]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*bucket)], ["h", "node", "n", "part", *shingles.SHORT])
    pairs = {(a, b) for out in shingles._apart(0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert {tuple(sorted((made[i]["node"], made[300 + i]["node"]))) for i in range(40)} <= pairs
    assert len(pairs) < 60  # of 57,630


def test_long_unlike_sets_of_a_bucket_are_not_paired(spark):
    """Texts of 900 words, too long for a map of 256 bits to tell apart; like ones are kept."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [[word() for _ in range(900)] for _ in range(60)]
    for w in [list(t) for t in texts[:10]]:
        w[rng.randrange(900)] = word()
        texts.append(w)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "i long, text string").repartition(3)
    made = {r["i"]: r for r in shingles._with_nodes(rows, 5).collect()}
    bucket = sorted(((1, r["node"], r["n"], r["node"], *(r[c] for c in shingles.SHORT)) for r in made.values()), key=lambda r: (r[2], r[1]))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*bucket)], ["h", "node", "n", "part", *shingles.SHORT])
    pairs = {(a, b) for out in shingles._apart(0.8)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert pairs == {tuple(sorted((made[i]["node"], made[60 + i]["node"]))) for i in range(10)}  # of 2,415
