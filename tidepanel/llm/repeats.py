"""Remove byte strings that occur more than once in the corpus, found by suffix arrays.

Every string of ``LENGTH`` bytes contains an anchor: of the hashed ``GRAM``-byte strings inside it the least, the
leftmost of equals. Equal strings have equal anchors at equal places, so only the surroundings of anchors that occur
again can hold a repeat.

1. Anchors are counted by hash; those that occur once are done with.
2. The context of an anchor is the text of all strings that have it as their anchor. Equal contexts are collapsed.
3. Different contexts of an anchor meet in a lane, whose suffix array is built by linear grouping (suffixes.py); equal
   strings are neighbours in it. An anchor with very many contexts is split over lanes; strings of such lanes are then
   matched by digest, each lane giving every string once.
4. What was found goes back to all occurrences, and each document cuts its own bytes.

Texts are shuffled by document, contexts by anchor, and nothing gathers the places of an anchor in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import Runs, slices, written
from tidepanel.llm.suffixes import suffix_arrays

LENGTH = 200
GRAM = 64
#: Contexts in a lane, and bytes of contexts that a task gathers for its suffix arrays.
LANE, SYMBOLS = 64, 6_000_000
#: Bytes of a symbol of the suffix arrays, and whole symbols in every string wherever it is cut.
WIDE = 8
CORE = (LENGTH - WIDE + 1) // WIDE
KEY = ["kid", "body"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first, number, hash, offset): each anchor's run of strings, by the place of the first string and their
    number, and where the anchor stands behind that place."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    line = np.frombuffer(b"".join(texts), np.uint8)
    window = LENGTH - GRAM + 1
    if len(line) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes = _mix(Runs(line.astype(np.uint64) + np.uint64(1)).every(GRAM))
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    # least of every window: blocks of its size, their running minima from the left and from the right
    pad = -len(ranked) % window
    blocks = np.append(ranked, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    number = len(ranked) - window + 1
    least = (np.minimum(behind[:number], ahead[window - 1 : window - 1 + number]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)[:number]
    whole = np.arange(number) + LENGTH <= ends[of]
    place, least, of = np.arange(number)[whole], least[whole], of[whole]
    if not len(place):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(of) != 0)]))
    run = np.diff(np.append(first, len(place)))
    return of[first], place[first] - starts[of[first]], run, hashes[least[first]], least[first] - place[first]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(_raw(part))[3].view(np.int64))], ["h"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = _raw(part)
            of, first, number, h, offset = anchors(texts)
            digest = xxhash.xxh3_64_intdigest
            d = np.array([digest(texts[t][a : a + n + LENGTH - 1]) for t, a, n in zip(of.tolist(), first.tolist(), number.tolist())], np.uint64)
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column("kid").take(row), part.column("body").take(row), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(offset.astype(np.int32))],
                ["kid", "body", "first", "number", "h", "d", "anchor"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed contexts of each document."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text, listed in zip(_raw(part), part.column("listed").to_pylist()):
                out += [(x["h"], x["salt"], x["salts"], x["d"], x["copies"], text[x["first"] : x["first"] + x["number"] + LENGTH - 1], x["anchor"]) for x in listed]
            yield _batch(out, CONTEXT)


CONTEXT = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("d", pa.int64()), ("copies", pa.int64()), ("context", pa.binary()), ("anchor", pa.int32())])
FOUND = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("first", pa.int32()), ("number", pa.int32()), ("string", pa.int64()), ("known", pa.bool_())])


def _words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts end to end as numbers of ``WIDE`` bytes, one free number behind each; where each context begins in
    them, and how many zero bytes stand before it. A number begins at every anchor, so equal strings are cut alike."""
    shift = np.array([-r[6] % WIDE for r in rows], np.int64)
    size = np.array([len(r[5]) for r in rows], np.int64)
    count = -(-(shift + size) // WIDE)
    end = np.cumsum(count + 1)
    begin = end - count - 1
    free = end * WIDE - begin * WIDE - shift - size
    zeros = bytes(2 * WIDE)
    line = b"".join(x for r, a, b in zip(rows, shift.tolist(), free.tolist()) for x in (zeros[:a], r[5], zeros[:b]))
    return np.frombuffer(line, np.uint64), begin, shift


def lane_repeats(rows: list[tuple]) -> Iterator[tuple]:
    """(h, d, first, number, string, known) of ``rows`` = (h, salt, salts, d, copies, context, anchor) sorted by lane.

    Without ``string``: a run of strings of a context that occur again. With it: one string of a lane of a split
    anchor by its digest, to be matched with the anchor's other lanes, so together with the hash of the anchor;
    ``known`` if it occurs again in its own lane.

    The symbols of the suffix array are numbers of ``WIDE`` bytes. Each string has ``CORE`` whole ones, and ``WIDE``
    bytes around them; strings are equal if their cores are equal neighbours and the bytes around them are equal.
    """
    words, begin, shift = _words(rows)
    end = np.append(begin[1:], len(words))
    size = np.array([len(r[5]) for r in rows], np.int64)
    inside = np.ones(len(words), bool)
    inside[end - 1] = False
    text = np.ones(len(words), np.int32)
    text[inside] = np.unique(words[inside], return_inverse=True)[1] + 2
    last = np.array([i + 1 == len(rows) or rows[i + 1][:2] != r[:2] for i, r in enumerate(rows)])
    text[end[last] - 1] = 0
    bounds = np.concatenate([[0], end[last]])
    array = suffix_arrays(text, bounds)
    context = np.repeat(np.arange(len(rows), dtype=np.int32), end - begin)
    full = array[end[context[array]] - 1 - array >= CORE]  # suffixes that begin with a whole core
    lane = np.searchsorted(bounds, full, side="right")
    left, right = full[:-1], full[1:]
    same = np.flatnonzero(lane[1:] == lane[:-1])
    for k in range(CORE):
        same = same[text[left[same] + k] == text[right[same] + k]]
    joined = np.zeros(len(full), bool)
    joined[same + 1] = True
    core = np.cumsum(~joined) - 1
    copies, split = np.array([r[4] for r in rows], np.int64), np.array([r[2] > 1 for r in rows], bool)
    beside = (np.bincount(core) > 1)[core] if len(core) else joined
    at = np.flatnonzero(beside | split[context[full]])  # other strings of a whole anchor are alone
    full, core = full[at], core[at]
    of = context[full]
    place = (full - begin[of]) * WIDE - shift[of]
    found, strings = [], []
    for before in range(WIDE):
        first = place - before
        fits = np.flatnonzero((first >= 0) & (first + LENGTH <= size[of]))
        head, tail = words[np.maximum(full[fits] - 1, 0)], words[full[fits] + CORE]
        around = tail << np.uint64(8 * before)
        if before:
            around |= head >> np.uint64(64 - 8 * before)
        by = np.lexsort((around, core[fits]))
        fits, around = fits[by], around[by]
        new = np.ones(len(fits), bool)
        new[1:] = (core[fits][1:] != core[fits][:-1]) | (around[1:] != around[:-1])
        kind = np.cumsum(new) - 1
        again = (np.bincount(kind, copies[of[fits]]) > 1)[kind] if len(kind) else new
        own = fits[again & (copies[of[fits]] == 1)]
        found.append(np.stack([of[own], place[own] - before]))
        one = new & split[of[fits]]
        strings.append((of[fits[one]], place[fits[one]] - before, again[one]))
    c, first = np.concatenate(found, axis=1)
    by = np.lexsort((first, c))
    c, first = c[by], first[by]
    if len(c):
        new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(c) != 0)]))
        for i, s, n in zip(c[new].tolist(), first[new].tolist(), np.diff(np.append(new, len(c))).tolist()):
            yield rows[i][0], rows[i][3], s, n, None, None
    for of_, first_, again_ in strings:
        for i, s, known in zip(of_.tolist(), first_.tolist(), again_.tolist()):
            yield rows[i][0], rows[i][3], s, 1, xxhash.xxh3_64_intdigest(rows[i][5][s : s + LENGTH]) - (1 << 63), known


def possible(lane: list[tuple]) -> list[tuple]:
    """Of all contexts of an anchor, those that can share a string with another one.

    A string has half of its bytes beside the anchor on one side at least, so contexts that share a string share those.
    """
    side = (LENGTH - GRAM) // 2
    halves = []
    for r in lane:
        context, at = r[5], r[6]
        left = context[at - side : at + GRAM] if at >= side else None
        right = context[at : at + GRAM + side] if len(context) - at >= GRAM + side else None
        halves.append(((0, left), (1, right)))
    seen = Counter(x for pair in halves for x in pair if x[1] is not None)
    return [r for r, pair in zip(lane, halves) if any(seen[x] > 1 for x in pair)]


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of the lanes of a partition that is sorted by lane."""
    held: list[tuple] = []
    symbols = 0

    def ready(rows: list[tuple]) -> pa.RecordBatch:
        lanes: dict = {}
        for r in rows:
            lanes.setdefault(r[:2], []).append(r)
        rest = [possible(lane) if lane[0][2] == 1 else lane for lane in lanes.values()]
        # lanes of like size go through the steps together
        ordered = [r for lane in sorted(rest, key=lambda x: sum(len(r[5]) for r in x)) for r in lane]
        return _batch(list(lane_repeats(ordered)) if ordered else [], FOUND)

    for batch in batches:
        for r in zip(*(batch.column(n).to_pylist() for n in CONTEXT.names)):
            if symbols > SYMBOLS and r[:2] != held[-1][:2]:
                yield ready(held)
                held, symbols = [], 0
            held.append(r)
            symbols += len(r[5])
    if held:
        yield ready(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            spans, kept = [], []
            for text, listed in zip(_raw(part), part.column("listed").to_pylist()):
                runs: list[list[int]] = []
                for a, b in sorted((x["first"], x["first"] + x["number"] + LENGTH - 1) for x in listed or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in runs])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            lens = pa.array([len(t) for t in _raw(part)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), lens, pa.array(spans, kind), pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``row`` (all its columns), ``n_bytes``, ``spans`` and ``kept``.

    ``spans`` are the maximal runs of bytes (start, stop) covered by strings of ``LENGTH`` bytes that also start
    anywhere else in the table, in the same text included; ``kept`` is the rest. Matches never cross texts. Null and
    short texts have no spans. Repeated rows are copies of each other. An empty table gives an empty result.
    """
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("kid"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    counts = keyed.select("text").mapInArrow(_anchor_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    counts = written(counts, "repeat-anchors", tidy=True)  # read from a table, so that adaptive execution may split a hot anchor's places
    found = keyed.select(*KEY, "text").mapInArrow(_occurrences, "kid string, body long, first int, number int, h long, d long, anchor int")
    places = written(found.join(counts, "h", "left_semi"), "repeat-places", tidy=True)
    contexts = places.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "first", "number", "anchor")).alias("at"))
    contexts = written(contexts, "repeat-contexts", tidy=True)
    lanes = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")  # one context: only copies
    lanes = lanes.select("h", F.ceil(F.col("contexts") / LANE).cast("int").alias("salts"))
    dealt = contexts.join(lanes, "h").withColumn("salt", F.pmod(F.xxhash64("d"), F.col("salts")).cast("int"))
    listed = dealt.groupBy(F.col("at.kid").alias("kid"), F.col("at.body").alias("body")).agg(
        F.collect_list(F.struct("h", "salt", "salts", "d", "copies", F.col("at.first").alias("first"), F.col("at.number").alias("number"), F.col("at.anchor").alias("anchor"))).alias("listed")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = written(listed, "repeat-lists", tidy=True)
    texts = keyed.select(*KEY, "text").join(listed, KEY).select("text", "listed")
    strings = texts.mapInArrow(_contexts, "h long, salt int, salts int, d long, copies long, context binary, anchor int")
    strings = strings.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "d")
    seen = written(strings.mapInArrow(_lanes, "h long, d long, first int, number int, string long, known boolean"), "repeat-runs", tidy=True)
    runs = seen.filter("string is null").select("h", "d", "first", "number")
    shared = seen.filter("string is not null").groupBy("h", "string").agg(F.count(F.lit(1)).alias("lanes")).filter("lanes > 1").drop("lanes")
    across = seen.filter("string is not null and not known").join(shared, ["h", "string"], "left_semi").select("h", "d", "first", "number")
    once = contexts.filter("copies = 1").select("h", "d", F.col("at.kid").alias("kid"), F.col("at.body").alias("body"), F.col("at.first").alias("base"))
    alone = once.join(runs.unionByName(across), ["h", "d"]).select(*KEY, (F.col("base") + F.col("first")).alias("first"), "number")
    copied = places.join(contexts.filter("copies > 1").select("h", "d"), ["h", "d"], "left_semi").select(*KEY, "first", "number")
    spans = alone.unionByName(copied).groupBy(*KEY).agg(F.collect_set(F.struct("first", "number")).alias("listed"))
    spans = written(spans, "repeat-spans", tidy=True)
    whole = keyed.drop("text").join(spans, KEY, "left")  # the text is shuffled in its row only
    whole = whole.select("row", F.coalesce(F.col("row")[text], F.lit("")).alias("text"), "listed")
    schema = f"row {whole.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"
    return whole.mapInArrow(_cut, schema)
