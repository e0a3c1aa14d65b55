"""SimHash fingerprints, and their linking within a few bits by self-joins of binary tries.

Links are looked for between distinct fingerprints only. Of the 64 bits, three blocks are formed: fingerprints that
differ in at most two bits agree in one block, so a trie whose top levels are that block, with no error allowed there,
finds them. The tries are cut below the block into buckets that fit a task; a bucket that is still too large is cut
again by three blocks of its free bits. After three cuts at most 2^20 distinct fingerprints can share a bucket, so the
memory of a task has a bound, whatever the data. In a bucket, pairs of trie nodes are walked from the root together;
a pair is dropped when its differing bits exceed the budget. Of the links found, a task keeps a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidepanel.llm.common import slices, with_fields, written
from tidepanel.llm.components import components

BITS = 64
#: A bucket with more fingerprints than this is cut again.
BUCKET = 20_000
#: Pairs of trie nodes that are held at once.
FRONTIER = 1_000_000


def fingerprint(texts: list[str | None], shingle: int, seed: int) -> np.ndarray:
    """Unsigned fingerprints of the texts."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            out[i] = digest(b" ".join(words), seed)
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        first, last = [0, *ends[: -shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(first, last)], ">u8")
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 4096):
            part = hashes[k : k + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Append the 64-bit SimHash of the lower-cased (A-Z) words of ``text`` as a signed long.

    A fingerprint bit is 1 if it is 1 in over half of the hashes of all shingles, repeats included. A text of fewer
    words is one shingle; a null or empty text has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values = fingerprint(part.column(text).to_pylist(), shingle, seed).view(np.int64)
                keep = [n for n in part.schema.names if n.lower() != out.lower()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(values)], [*keep, out])

    return df.mapInArrow(run, with_fields(df.schema, StructField(out, LongType())))


def _blocks(bits: list[int]) -> list[int]:
    """Masks of three blocks that together cover ``bits``."""
    cut = [len(bits) * k // 3 for k in range(4)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cut, cut[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(levels: int = 3) -> list[dict[int, list[int]]]:
    """For each level of cutting, the masks that follow each mask of the level before (0 at first)."""
    out, level = [], [0]
    for _ in range(levels):
        step = {m: [m | b for b in _blocks([i for i in range(BITS) if not m >> i & 1])] for m in level}
        out.append({_signed(m): [_signed(x) for x in v] for m, v in step.items()})
        level = list(dict.fromkeys(x for v in step.values() for x in v))
    return out


def trie_pairs(fps: np.ndarray, start: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints of one bucket that differ in at most ``budget`` bits.

    ``fps`` is sorted and distinct inside each bucket; ``start`` has the bounds of the buckets. A trie node is a range
    of the sorted array whose members share their leading bits; a range of one member is a leaf.
    """
    left, right = [], []
    lo, hi = start[:-1], start[1:]
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[leaf], b0[leaf]
        near = (np.bitwise_count(fps[x] ^ fps[y]) <= budget) & (x != y)
        left.append(x[near])
        right.append(y[near])
        a0, a1, b0, b1, diff = (v[~leaf] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            for k in range(0, len(a0), FRONTIER // 4):
                stack.append((bit, *(v[k : k + FRONTIER // 4] for v in (a0, a1, b0, b1, diff))))
            continue
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        twin = a0 == b0
        children = [
            (a0, am, b0, bm, diff, None), (am, a1, bm, b1, diff, None),
            (a0, am, bm, b1, diff + 1, None), (am, a1, b0, bm, diff + 1, ~twin),
        ]
        kept = []
        for p, q, r, s, d, also in children:
            ok = (q > p) & (s > r) & (d <= budget)
            ok = ok if also is None else ok & also
            kept.append([v[ok] for v in (p, q, r, s, d)])
        stack.append((bit - 1, *(np.concatenate(v) for v in zip(*kept))))
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that it can reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            fps = rows[2].view(np.uint64)
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            order = np.lexsort((fps, np.searchsorted(new, np.arange(len(fps)), side="right")))
            fps = fps[order]
            left, right = trie_pairs(fps, np.concatenate([[0], new, [len(fps)]]), budget)
            nodes, place = np.unique(np.concatenate([fps[left], fps[right]]), return_inverse=True)
            root = forest(len(nodes), place[: len(left)], place[len(left) :])
            own = root != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own].view(np.int64)), pa.array(nodes[root[own]].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= 200_000:
                rows = np.concatenate(held, axis=1)
                cut = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
                if len(cut):
                    yield links(rows[:, : cut[-1] + 1])
                    rows = rows[:, cut[-1] + 1 :]
                held = [rows]
        rows = np.concatenate(held, axis=1) if held else np.zeros((3, 0))
        if rows.shape[1]:
            yield links(rows)

    return run


def near_links(fps: DataFrame, budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that differ in at most ``budget`` (at most 2) bits.

    The links form a spanning forest of each bucket, so they reach what all links reach.
    """
    if budget > 2:
        raise ValueError("three blocks find links of at most two bits")
    level = fps.select(F.lit(0).cast("long").alias("mask"), "fp").distinct()
    ready = None
    steps = masks()
    for k, step in enumerate(steps):
        children = F.create_map(*(x for m, v in step.items() for x in (F.lit(m), F.array(*(F.lit(c) for c in v)))))
        cells = level.select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        cells = cells.distinct() if k else cells  # later masks may come from several
        cells = cells.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        counts = cells.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        cells = written(cells.join(counts, ["mask", "value"]).select("mask", "value", "fp", "n"), "buckets")
        small = cells if k == len(steps) - 1 else cells.filter(F.col("n") <= bucket)
        ready = small if ready is None else ready.unionByName(small)
        level = cells.filter(F.col("n") > bucket).select("mask", "fp")
        if k < len(steps) - 1 and level.isEmpty():
            break
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.select("mask", "value", "fp").repartition(parts, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(_bucket_links(budget), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``fp``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest ``key`` that links can reach from the document, itself included; a null key counts
    only where there is no other. ``kept`` is true for one document of each component: the one with that key, of
    repeated rows the first. Null and empty texts have fingerprint 0 and are linked like any other. An empty table
    gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("at"))
    rows = written(with_fingerprint(rows).drop("text"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("least"))
    roots = components(near_links(nodes.select("fp"), budget, bucket))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("keep"))
    of_fp = placed.select("fp", "root").join(least, "root").select("fp", "keep")
    return rows.join(of_fp, "fp").select("row", "fp", F.col("keep.id").alias("component_id"), (F.col("at") == F.col("keep.at")).alias("kept"))
