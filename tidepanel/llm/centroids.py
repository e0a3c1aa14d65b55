"""Clustering of integer vectors around centroids by popcounts of bit planes.

A vector of 64 integers in two's complement of ``width`` bits is ``width`` words of 64 bits: word ``j`` holds bit ``j``
of every component. The dot product of two vectors is then the weighted sum of the set bits that each plane of the one
shares with each plane of the other, and distances are exact.

The planes are written once; every round reads them, assigns the vectors beside the centroids (``k`` x 64 numbers, sent
with the task) and returns the sums of each cluster, added up within a task before they are shuffled by cluster and
component. The driver holds centroids and sums only, ``k`` x 64 numbers whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidepanel.llm.common import written

DIM = 64
SCALE = 256
#: Scaled components below this size keep every squared distance within 64 bits; larger ones are an error.
LIMIT = 2**27
#: Vectors whose counts are held at once.
BLOCK = 512


def scaled(vector: Column) -> Column:
    """``floor(256 * x)`` of every component, or null unless the vector has 64 components, all of them finite."""
    usable = (F.size(vector) == DIM) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(usable, F.transform(vector, _scaled_component))


def _scaled_component(x: Column) -> Column:
    v = F.floor(x.cast("double") * SCALE)
    return F.when(F.abs(x.cast("double")) * SCALE < LIMIT - 1, v).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("long"))


def planes_of(ints: np.ndarray, width: int) -> np.ndarray:
    """(n, width) words of the (n, 64) integers."""
    bits = (ints[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def ints_of(planes: np.ndarray) -> np.ndarray:
    """The (n, 64) integers of (n, width) words."""
    n, width = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes, "<u8").view(np.uint8).reshape(n, width, 8), axis=2, bitorder="little")
    return np.einsum("nwd,w->nd", bits.astype(np.int64), weights(width))


def weights(width: int) -> np.ndarray:
    """What a set bit of each plane adds; the last plane holds the sign."""
    w = np.int64(1) << np.arange(width, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact dot products of all vectors with all others, by AND and popcount of each pair of planes."""
    w = weights(planes.shape[1])
    out = np.zeros((len(planes), len(others)), np.int64)
    for i in range(planes.shape[1]):
        shared = np.bitwise_count(planes[:, i, None, None] & others[None, :, :])
        out += w[i] * np.matmul(shared.astype(np.float64), w.astype(np.float64)).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number of equals, and the squared distance."""
    w = weights(planes.shape[1])
    cluster, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    others = planes_of(centroids, planes.shape[1])
    lengths = (centroids**2).sum(axis=1)
    for at in range(0, len(planes), BLOCK):
        part = planes[at : at + BLOCK]
        own = np.einsum("nij,i,j->n", np.bitwise_count(part[:, :, None] & part[:, None, :]).astype(np.int64), w, w)
        far = own[:, None] + lengths[None, :] - 2 * dots(part, others)
        best = far.argmin(axis=1)
        cluster[at : at + BLOCK], distance[at : at + BLOCK] = best, far[np.arange(len(part)), best]
    return cluster, distance


def _words(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("planes").to_pylist()), "<u8").reshape(-1, width)


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            words = planes_of(ints, width)
            packed = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), packed], ["row", "planes"])

    return run


def _sums(width: int, centroids: np.ndarray):
    """The task's part of every cluster: number and component sums of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        number, total = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
        for batch in batches:
            words = _words(batch, width)
            for at in range(0, len(words), 8 * BLOCK):
                part = words[at : at + 8 * BLOCK]
                cluster, _ = nearest(part, centroids)
                number += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, ints_of(part))
        seen = np.flatnonzero(number)
        at = np.repeat(seen, DIM)
        dim = np.tile(np.arange(DIM), len(seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(dim, pa.int32()), pa.array(number[at]), pa.array(total[at, dim])], ["cluster", "dim", "n", "total"]
        )

    return run


def _assign(width: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_words(batch, width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cluster), pa.array(distance)], ["row", "cluster", "distance"])

    return run


def _moved(packed: DataFrame, width: int, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floored mean of each cluster, an empty one as it was."""
    parts = packed.select("planes").mapInArrow(_sums(width, centroids), "cluster int, dim int, n long, total long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(wide("n"), wide("total")).collect():  # k x 64 rows at most
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", k: int = 40, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Assign every usable vector to one of ``k`` centroids after ``rounds`` rounds of exact integer means.

    Returns ``(row, cluster, distance)`` per kept vector, ``row`` holding the caller's other columns, and
    ``(cluster, centroid, cluster_inertia, inertia)`` per centroid. Centroids start as the vectors whose
    ``2:<id>`` has the least sha256, ties by components; fewer vectors than ``k`` give fewer centroids.

    A vector that is null, has not 64 components, or has a null or non-finite one is left out. A null id counts as an
    empty text in the hash. Repeated rows are vectors of their own, equal distances go to the smaller number, an empty
    table gives no rows, and columns of any name travel in ``row``. Components of 2**19 or more are an error.
    """
    spark = vectors.sparkSession
    others = [F.col(f"`{f.name}`") for f in vectors.schema.fields if f.name != column]
    kept = vectors.select(F.struct(*others).alias("row"), scaled(F.col(f"`{column}`")).alias("v"), F.col(f"`{id_column}`").cast("string").alias("id")).filter("v is not null")
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce("id", F.lit(""))).cast("binary"), 256)
    starts = [r["v"] for r in kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()]
    bounds = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    row = kept.schema["row"]
    if not starts:
        none = spark.createDataFrame([], StructType([row]))
        return (
            none.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")),
            spark.createDataFrame([], "cluster int, centroid array<long>, cluster_inertia long, inertia long"),
        )
    width = max((-bounds[0] - 1).bit_length() if bounds[0] < 0 else 0, max(bounds[1], 0).bit_length()) + 1
    packed = written(kept.select("row", "v").mapInArrow(_pack(width), StructType([row]).add("planes", "binary")), "planes")
    centroids = np.array(starts, np.int64)
    for _ in range(rounds):
        centroids = _moved(packed, width, centroids)
    fields = StructType([row]).add("cluster", IntegerType()).add("distance", "long")
    placed = written(packed.mapInArrow(_assign(width, centroids), fields), "clusters")
    held = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, [int(x) for x in v], held.get(c, 0), sum(held.values())) for c, v in enumerate(centroids)]
    return placed, spark.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")

