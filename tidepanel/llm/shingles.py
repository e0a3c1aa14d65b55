"""Near copies of texts: all pairs whose sets of word shingles are similar enough, and what they link.

Fingerprints come first: texts whose SimHash over the same shingles differs in at most two bits, as the self-joins of
tries (``simhash``) link them, are paired and confirmed on their sets. Similar sets may differ in more bits, so an exact
join finds the rest. Shingles are put in one order, common ones last; of two sets of Jaccard similarity s or more, the
first ``n - ceil(s n) + 1`` shingles of each (n is its size) have one in common, so only these are dealt out. In a
bucket of a shingle, the sets are first paired with their neighbours by size, which links large groups of copies by
few pairs; then all pairs of the bucket that no links join yet are tried.

A set also has a map of about as many bits as it has shingles, each the parity of the shingles that fall on it. Two maps
differ in at most as many bits as the sets have shingles apart, so a pair whose maps differ in too many is none. A short
map of 1,024 bits is at hand in the buckets, so pairs of unlike texts of up to some 2,000 words end there and are never
joined with anything. All others are confirmed on the whole sets. Sets are made from the texts where they are needed:
texts take less space than the hashes of their shingles. Only maps and prefixes of all sets are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from tidepanel.llm import simhash
from tidepanel.llm.common import slices, with_fields, written
from tidepanel.llm.components import components

#: Documents that tell which shingles are common, and how many of these are told; they order the shingles only.
SAMPLE, COMMON = 4000, 200_000
#: Pairs that are held at once before they are handed on; no pair depends on it.
PAIRS = 100_000
#: Columns of 64 bits that make up the short map of a set.
SHORT = [f"s{i}" for i in range(16)]
#: Columns of a set's least buckets, of which it repeats the last if it has fewer.
LEAST = [f"l{i}" for i in range(4)]
#: Nodes (a long each) that are broadcast to find their texts; more are joined by a shuffle.
SENT = 2_000_000
#: Bits in which the fingerprints of a pair may differ; the seed of their hashes.
BUDGET, SEED = 2, 42


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the lower-cased (A-Z) words; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return np.array([digest(b" ".join(w))] if w else [], np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    first, last = [0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist()
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(first, last)], np.uint64))


def _parity(hashes: np.ndarray, bits: int | None = None) -> bytes:
    bits = bits or max(64, 1 << max(0, len(hashes) - 1).bit_length())
    places = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _with_nodes(df: DataFrame, words: int) -> DataFrame:
    """Append ``fp`` (the fingerprint of ``text``, which goes), ``node`` (a digest of its set of shingles), ``n``, ``map`` and ``SHORT`` (of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                fps = simhash.fingerprint(texts, words, SEED).view(np.int64)
                sets = [shingles(t, words) for t in texts]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                keep = [n for n in part.schema.names if n != "text"]
                made = [pa.array(fps), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([_parity(s) for s in sets], pa.binary())]
                short = np.frombuffer(b"".join(_parity(s, 64 * len(SHORT)) for s in sets), np.int64).reshape(-1, len(SHORT))
                made += [pa.array(c) for c in short.T]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made], [*keep, "fp", "node", "n", "map", *SHORT])

    schema = with_fields(df.drop("text").schema, StructField("fp", LongType()), StructField("node", LongType()), StructField("n", LongType()), StructField("map", BinaryType()), *(StructField(c, LongType()) for c in SHORT))
    return df.mapInArrow(run, schema)


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Common shingles, the most common ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in part.column("text").to_pylist()]).view(np.int64))], ["h"])

    some = texts.filter("n < 20000").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 2")
    rows = counts.orderBy(F.desc("k"), "h").limit(COMMON).select("h").toArrow()
    return rows.column("h").to_numpy().view(np.uint64)[::-1]


def _prefixes(texts: DataFrame, common: np.ndarray, words: int, least: float) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rank = held.value
        out, size = [], 0

        def dealt() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h", "node", "n"])

        for part in (part for batch in batches for part in slices(batch, "text")):
            for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                own = shingles(text, words)
                if not len(own):
                    continue
                place = np.zeros(len(own), np.int64)
                if len(names):
                    at = np.searchsorted(names, own).clip(max=len(names) - 1)
                    place = np.where(names[at] == own, rank[at] + 1, 0)
                first = own[np.lexsort((own, place))[: len(own) - _least_shared(len(own), least) + 1]]
                k = len(first)
                out.append((first.view(np.int64), np.full(k, node), np.full(k, len(own))))
                size += k
                if size > 200_000:
                    yield dealt()
                    out, size = [], 0
        if out:
            yield dealt()

    return texts.select("node", "text").mapInArrow(run, "h long, node long, n long")


def _least_shared(n: int, least: float) -> int:
    return int(np.ceil(least * n - 1e-9))


def _most_apart(both: np.ndarray, least: float) -> np.ndarray:
    """Shingles that only one of two similar sets can have, for sets of ``both`` shingles in all."""
    return both * (1 - least) / (1 + least) + 1e-6


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets (runs of equal ``h``, the first column) of rows sorted by it."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(h.shape[1] for h in held) >= 200_000:
            rows = np.concatenate(held, axis=1)
            cut = np.flatnonzero(np.diff(rows[0]) != 0)
            if len(cut):
                yield list(rows[:, : cut[-1] + 1])
                rows = rows[:, cut[-1] + 1 :]
            held = [rows]
    if held:
        rows = np.concatenate(held, axis=1)
        if rows.shape[1]:
            yield list(rows)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets of two or more sets, each with the set before it in its bucket (itself if it is the first)."""
    for h, node, n in _buckets(batches):
        new = np.append(True, (np.diff(h) != 0) | (np.diff(node) != 0))  # equal sets of a bucket stand together
        h, node, n = h[new], node[new], n[new]
        same = h[1:] == h[:-1]
        follows, leads = np.append(False, same), np.append(same, False)
        before = np.where(follows, np.append(node[:1], node[:-1]), node)
        keep = follows | leads
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, node, n, before)], ["h", "node", "n", "before"])


def _least_buckets(shared: DataFrame) -> DataFrame:
    """``node`` and ``LEAST``: the least of the buckets that the set is in, in ascending order."""
    own = shared.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("h")), 1, len(LEAST)).alias("own"))
    return own.select("node", *(F.coalesce(F.get("own", F.lit(i)), F.element_at("own", -1)).alias(c) for i, c in enumerate(LEAST)))


def _apart(least: float):
    """Pairs of each bucket, of sets of fitting sizes that no links join and whose short maps do not rule them out.

    Near copies meet in most of their buckets. If the least buckets of two sets have some in common, the pair is left to
    the first of these: both sets are in it, and whether they make a pair there depends on the sets alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0

        def pairs() -> pa.RecordBatch:
            a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        for h, node, n, root, *more in _buckets(batches):
            short = np.stack(more[: len(SHORT)], axis=1).view(np.uint64)  # bits of signed numbers are counted without their sign
            first = np.stack(more[len(SHORT) :] or [h], axis=1)  # without such columns every bucket gives its pairs
            edges = np.append(np.flatnonzero(np.append(True, np.diff(h) != 0)), len(h))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if (root[lo:hi] == root[lo]).all():
                    continue
                for i in range(lo, hi - 1):
                    end = lo + np.searchsorted(n[lo:hi], n[i] / least + 1e-6, side="right")
                    others = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
                    bits = np.bitwise_count(short[others] ^ short[i]).sum(axis=1, dtype=np.int64)
                    others = others[bits <= _most_apart(n[i] + n[others], least)]
                    met = (first[others][:, :, None] == first[i]).any(axis=1)
                    others = others[~met.any(axis=1) | (first[i][met.argmax(axis=1)] == h[i])]
                    if len(others):
                        left.append(np.full(len(others), node[i]))
                        right.append(node[others])
                        held += len(others)
                    if held > PAIRS:
                        yield pairs()
                        left, right, held = [], [], 0
        yield pairs()

    return run


def _close(least: float):
    """Pairs whose maps ``x`` and ``y`` do not rule them out; the longer map is folded to the length of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in "xy")
            bound = _most_apart(batch.column("m").to_numpy() + batch.column("n").to_numpy(), least)
            sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)]).reshape(-1, 2)
            kept = np.zeros(len(x), bool)
            for pair in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == pair).all(axis=1))
                short = int(pair.min()) // 8
                a, b = (np.bitwise_xor.reduce(np.frombuffer(b"".join(v[i] for i in rows), np.uint64).reshape(len(rows), -1, short), axis=1) for v in (x, y))
                kept[rows] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= bound[rows]
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _confirm(words: int, least: float):
    """Pairs whose texts ``x`` and ``y`` have similar sets; a text that a slice has several times is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "x")):
            kept, sets = [], {}
            for i, (a, b, x, y) in enumerate(zip(*(part.column(c).to_pylist() for c in "abxy"))):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = shingles(text, words)
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both + 1e-9 >= least * (len(sets[a]) + len(sets[b]) - both):
                    kept.append(i)
            yield part.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def fingerprint_pairs(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints ``fp`` are equal or linked within ``budget`` bits, from rows of ``fp`` and ``node``.

    A fingerprint stands for its least node: the others are paired with that one, and of linked fingerprints the least
    nodes are paired. So there are fewer pairs than fingerprints' links and nodes, however large a group is.
    """
    nodes = rows.select("fp", "node").distinct()
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    links = simhash.near_links(heads.select("fp"), budget)
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    pairs = links.join(left, "a").join(right, "b").select("x", "y")
    pairs = pairs.unionByName(nodes.join(heads, "fp").select(F.col("head").alias("x"), F.col("node").alias("y")))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``component_id`` and ``kept``.

    Documents are linked if the Jaccard similarity of their sets of shingles of ``words`` words is ``least`` or more;
    null and empty texts are linked with each other. ``component_id`` is the smallest ``key`` that links can reach from
    the document, itself included; a null key counts only where there is no other. ``kept`` is true for one document
    of each component: the one with that key, of repeated rows the first. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("at"))
    rows = written(_with_nodes(rows, words), "nodes")
    texts = rows.select("node", "n", F.col("row")[text].alias("text"))
    dealt = _prefixes(texts, _common(texts, words), words, least).repartition(parts, "h").sortWithinPartitions("h", "n", "node")
    shared = written(dealt.mapInArrow(_neighbours, "h long, node long, n long, before long"), "shared-shingles")
    maps = rows.select("node", "n", "map", *SHORT).join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    maps = written(maps, "shared-maps")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = maps.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("map").alias("x"))
        right = maps.select(F.col("node").alias("b"), "n", F.col("map").alias("y"))
        close = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_close(least), "a long, b long")
        close = written(close, "close-pairs")
        named = written(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "close-nodes")
        named = F.broadcast(named) if named.count() <= SENT else named  # whole texts are not shuffled to find some
        own = written(texts.join(named, "node", "left_semi").dropDuplicates(["node"]).select("node", "text"), "close-texts")
        both = close.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(_confirm(words, least), "a long, b long"), "near-links")

    beside = shared.filter("node <> before").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct()
    tried = written(beside.unionByName(fingerprint_pairs(rows)).distinct(), "first-pairs")
    links = confirmed(tried)
    roots = components(links).withColumnRenamed("root", "part")
    placed = maps.select("node", *SHORT).join(roots, "node", "left").withColumn("part", F.coalesce("part", "node"))
    rest = shared.join(placed.join(_least_buckets(shared), "node"), "node").select("h", "node", "n", "part", *SHORT, *LEAST)
    rest = rest.repartition(parts, "h").sortWithinPartitions("h", "n", "node").mapInArrow(_apart(least), "a long, b long")
    links = links.unionByName(confirmed(rest.distinct().join(tried, ["a", "b"], "left_anti")))
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("first"))
    placed = nodes.join(components(links), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("keep"))
    of_node = placed.select("node", "root").join(firsts, "root").select("node", "keep")
    return rows.join(of_node, "node").select("row", F.col("keep.id").alias("component_id"), (F.col("at") == F.col("keep.at")).alias("kept"))
