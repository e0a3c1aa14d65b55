"""Centroid clustering against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, row string, cluster string, planes string, v int"


def brute(rows, k, rounds):
    kept = []
    for r in rows:
        x = r[1]
        if x is not None and len(x) == 64 and all(c is not None and np.isfinite(np.float32(c)) for c in x):
            kept.append((r[0], [int(np.floor(float(np.float32(c)) * 256)) for c in x]))
    mark = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, _, v in sorted((mark(i), v, v) for i, v in kept)[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        return [(row.index(min(row)), min(row)) for row in far]

    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (at, _) in zip(kept, of) if at == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((str(i), at, d) for (i, _), (at, d) in zip(kept, assign())), centres


def vectors(seed, n, scale):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=64) * scale).astype(np.float32).tolist()) for i in range(n)]
    rows += [rows[0], rows[1], (n + 1, rows[2][1]), (None, rows[3][1])]  # repeated rows, equal vectors, a null id
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] + [0.0] * 63, [float("-inf")] + [0.0] * 63, [None] + [0.0] * 63]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    return [(*r, "own row", "own cluster", "own planes", 7) for r in rows]


@pytest.mark.parametrize("seed,n,k,scale", [(1, 90, 7, 0.1), (2, 60, 40, 0.0), (3, 50, 5, 900.0), (4, 4, 40, 1.0)])
def test_same_as_plain_arithmetic(spark, seed, n, k, scale):
    rows = vectors(seed, n, scale)
    placed, found = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), k=k, rounds=3)
    expected, centres = brute(rows, k, 3)
    out = placed.select("row.*", F.col("cluster").alias("at"), "distance").collect()
    assert sorted((str(r["vec_id"]), r["at"], r["distance"]) for r in out) == expected
    assert {(r["row"], r["cluster"], r["planes"], r["v"]) for r in out} == {("own row", "own cluster", "own planes", 7)}
    table = {r["cluster"]: r for r in found.collect()}
    assert [table[c]["centroid"] for c in range(len(centres))] == centres
    for c, r in table.items():
        assert r["cluster_inertia"] == sum(d for _, at, d in expected if at == c)
        assert r["inertia"] == sum(d for _, _, d in expected)


def test_no_vector(spark):
    placed, found = centroids.cluster(spark.createDataFrame([(1, None, "", "", "", 1)], SCHEMA))
    assert placed.count() == 0 and found.count() == 0
    assert placed.columns == ["row", "cluster", "distance"]


def test_components_beyond_exact_distances(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, "", "", "", 1)], SCHEMA))


def test_dots():
    rng = np.random.default_rng(5)
    for width in (1, 2, 9, 28):
        top = 2 ** (width - 1)
        a, b = rng.integers(-top, top, (30, 64)), rng.integers(-top, top, (9, 64))
        planes = centroids.planes_of(a, width)
        assert (centroids.ints_of(planes) == a).all()
        assert (centroids.dots(planes, centroids.planes_of(b, width)) == a @ b.T).all()
