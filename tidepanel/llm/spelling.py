"""Spelling variants: words one edit apart, found by sorting rotations of terminator-marked words.

The rotation of a marked word that ends with the character at place ``i`` is ``w[i+1:] | w[:i]`` followed by that
character. Words that differ by a replacement at ``i`` share all of it but the last character, and the word that lacks
the character has the shared part as a whole rotation of its own. So every rotation is listed twice: whole, without a
last character, and cut before its last character. Sorted by (part, last character), a group of equal parts is a run:
at most one word that ends there, then one word for each last character. A run is thus no longer than the alphabet,
whatever the number of words, and a word's best neighbour is the best before or behind it.

A character repeated in a row can be deleted at any of its places with the same result; the pair is counted at the
first of them only. Rows carry the word's number in code-point order instead of its text, and a part of more than
``EXACT`` bytes is named by two 128-bit digests of its two sides, made in one pass over the word, so a word of ``n``
characters takes memory in proportion to ``n`` and not to its square.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, written

LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words that a task counts before it hands them on, and rotations in a batch.
HELD, BATCH = 300_000, 100_000
#: Bytes up to which a part stands for itself. No UTF-8 text holds the two marks.
EXACT = 48
END, DIGEST = b"\xff", b"\xfe"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower(run: str) -> str:
    """``run`` with A-Z in lower case and everything else as it is."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def misspelt(prefix: int, run: str, rate: int = 97) -> str:
    """``run`` without one character if ``rate`` divides the crc32 that goes on from ``prefix`` with the run."""
    h = zlib.crc32(run.encode(), prefix)
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int, change: Callable[[int, str], str] | None):
    # a change takes one character away at most, so a run shorter than ``least`` makes no word
    runs = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for found, n in Counter(runs(text or "")).items():
                        word = lower(found)
                        word = change(prefix, word) if change else word
                        if len(word) >= least:
                            held[word] += n
                    if len(held) > HELD:
                        yield emit(held)
                        held = Counter()
        yield emit(held)

    return run


def count_words(docs: DataFrame, least: int = 5, change: Callable[[int, str], str] | None = None) -> DataFrame:
    """``(word, n)``: runs of letters of at least ``least`` code points, only A-Z lower-cased, over all documents.

    ``change`` may turn a run into another word; it gets the crc32 of ``<doc_id>:`` and the run. A null text has no
    words, a null id is empty, repeated rows count again, an empty table has no words. Other columns are not read.
    """
    counts = docs.select("doc_id", "text").mapInArrow(_count(least, change), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def parts(word: str) -> Iterator[tuple[bytes, int, bool]]:
    """(part, last character, whether the pair with the word that lacks it counts here) of every rotation.

    A whole rotation has 0 for its last character.
    """
    raw = [c.encode() for c in word]
    size = sum(map(len, raw)) + len(END)
    line = b"".join(raw)
    if size > EXACT:
        heads, tails = _digests(raw), _digests(raw[::-1])
    name = lambda n, head, tail, i, j: line[tail:] + END + line[:head] if n <= EXACT else DIGEST + tails[len(raw) - j] + heads[i]
    at = 0
    for i, c in enumerate(raw):
        yield name(size, at, at, i, i), 0, False
        yield name(size - len(c), at, at + len(c), i, i + 1), ord(word[i]) + 1, i == 0 or word[i] != word[i - 1]
        at += len(c)
    yield name(size, at, at, len(raw), len(raw)), 0, False


def _digests(raw: list[bytes]) -> list[bytes]:
    """Digest of the first 0, 1, ... characters."""
    state = xxhash.xxh3_128()
    out = [state.digest()]
    for c in raw:
        state.update(c)
        out.append(state.digest())
    return out


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "last", "lead", "id", "n"]
    kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    for batch in batches:
        held: list[list] = [[] for _ in names]
        for i, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            for part, last, lead in parts(word):
                for column, value in zip(held, (part, last, lead, i, n)):
                    column.append(value)
                if len(held[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names)
                    held = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names)


def neighbours(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of every word of ``(id, word, n)`` that is one edit from another; ``best`` is the near
    word ``(n, minus)`` of largest ``n``, of equals that with the least id (``minus`` is the id negated)."""
    rows = words.mapInArrow(_rotations, "part binary, last int, lead boolean, id long, n long")
    run = Window.partitionBy("part").orderBy("last")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n", (-F.col("id")).alias("minus"))
    long = F.col("last") > 0
    scanned = rows.select(
        "id", "last", "lead",
        F.count(F.lit(1)).over(whole).alias("_all"),
        F.min("last").over(whole).alias("_least"),
        F.sum(F.col("lead").cast("int")).over(whole).alias("_leads"),
        F.max(one).over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.max(one).over(run.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"),
    ).filter("_all > 1")
    ends = F.col("_least") == 0  # a word ends at the part; the others have one character more
    longs = F.col("_all") - ends.cast("int")
    near = F.when(long, longs - 1 + (ends & F.col("lead")).cast("int")).otherwise(F.col("_leads"))
    return scanned.groupBy("id").agg(F.sum(near).alias("n_near"), F.max(F.greatest("_before", "_behind")).alias("best"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every word of ``(word, n)``.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its near
    word of largest ``n`` (ties: the first in code-point order) if that is at least ``ratio`` times its own, its root
    the last word reached by following forms. ``ratio`` must be over 1, so that forms cannot lead in a circle; a chain
    then has at most log(largest n) links. Every step joins words with the forms found in the step before; a word is
    the form of near words only, so no key of these joins is hot.

    Rows with a null word or count, or a count below 1, are left out; repeated words count together; an empty table
    gives no rows; columns other than these two are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    counted = words.filter("word is not null and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    # numbers in code-point order, written so that they stay
    ordered = written(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.col("best.n") >= ratio * F.col("n")
    linked = ordered.join(neighbours(ordered), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best, -F.col("best.minus")).alias("up"), F.when(best, F.col("best.n")).alias("form_n")
    )
    linked = written(linked, "linked")
    out = level = linked.filter("up is null").select("id", "word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"))
    changed = linked.filter("up is not null")
    while True:
        above = level.select(F.col("id").alias("up"), F.col("word").alias("form"), "root")
        level = written(changed.join(above, "up").select("id", "word", "n", "n_near", "form", "form_n", "root"), "level")
        if level.isEmpty():
            return out.drop("id")
        out = out.unionByName(level)
