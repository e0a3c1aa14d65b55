"""The fingerprint step of the near stage."""

import random

import numpy as np

import corpus_pipeline
from tidepanel.llm import shingles


def test_fingerprints_within_two_bits_are_paired(spark):
    """The stage's first step is the trie join of fingerprints over five words, not the prefixes alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(3000)]
        texts += [" ".join(base), " ".join([*base[:-1], word()]), " ".join([word(), *base[1:]])]
    fps = shingles.simhash.fingerprint(texts, 5, shingles.SEED)
    texts = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    rows = shingles._with_nodes(texts, 5).persist()
    own = {r["i"]: r["node"] for r in rows.collect()}
    assert {r["i"]: r["fp"] for r in rows.collect()} == dict(enumerate(fps.view(np.int64).tolist()))
    found = [(r["a"], r["b"]) for r in shingles.fingerprint_pairs(rows).collect()]
    assert found and all(a < b for a, b in found)
    root = {n: n for n in own.values()}
    for _ in root:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    assert len(near) >= 8
    assert all(root[own[i]] == root[own[j]] for i, j in near)


def test_near_stage_runs_the_trie_join(spark, monkeypatch):
    calls, links = [], shingles.simhash.near_links
    monkeypatch.setattr(shingles.simhash, "near_links", lambda fps, *a, **b: calls.append(fps.columns) or links(fps, *a, **b))
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()} == {1, 3}
    assert calls == [["fp"]]
