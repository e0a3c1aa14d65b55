"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

1. Documents are encoded and cut into pieces of at most ``capacity`` tokens, and the pieces are written.
2. The number of pieces of every length, at most ``capacity`` numbers, is all that planning needs. Best fit takes the
   lengths from long to short and always the fullest sequence that still has room; sequences with equal room are
   handled together, as runs of sequence numbers, so planning takes no longer for more documents. A run that a length
   fills is left with less than half its room, so the plan has at most 3 x capacity x log2(capacity) entries.
3. Every entry gives the pieces of one length from one rank to another their sequences and offsets. Ranks within a length
   are counted within the part of the table that a task wrote, plus what earlier parts hold, so a length that a third
   of all pieces have is ranked by many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from tidepanel.llm.common import slices, with_fields, written

CAPACITY = 2048
#: Token that ends a document.
END = 0
#: Distinct words that a worker remembers; beyond that it forgets all of them.
REMEMBERED = 500_000
#: Bytes of text in a slice, words in a line for the model.
SLICE, LINE = 16_000_000, 1000
ID_BYTES = 4

# Chunks of these characters only are split here; all others go through the whole tokenizer. Normalizing leaves their
# lower case as it is, and the words below are those of the tokenizer's own pattern, which treats ' in its own way.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]*").fullmatch
_ODD = re.compile(r"[^\n!-&(-~À-ÖØ-öø-ÿ]").search
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+").findall
#: The byte-level alphabet shows a byte without a printable Latin-1 character as the next character from 256 on.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Encoder:
    """Ids of texts, in one array, and how many each text has.

    Texts are cut at white space and each distinct chunk of a slice is looked at once; no rule of the tokenizer looks
    across white space. Plain chunks are cut into words, and new words go to the tokenizer's model many to a line.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = self.whole.model.end_of_word_suffix
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {"\n": b""}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """A word's last id, and no other, stands for a token with the end-of-word mark."""
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN) for w in words]
        lines = [" ".join(shown[at : at + LINE]) for at in range(0, len(shown), LINE)]
        ids = np.concatenate([np.zeros(0, "<u4"), *self._ids(self.model, lines)])
        stop = (np.flatnonzero(self.ends[ids]) + 1) * ID_BYTES
        raw = ids.tobytes()
        self.words.update(zip(words, map(raw.__getitem__, map(slice, [0, *stop[:-1].tolist()], stop.tolist())), strict=True))

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of plain chunks: those of their words, which are all found in one pass."""
        words = _WORDS("\n".join(chunks).lower())
        found = list(map(self.words.get, words))
        new = {w for w, ids in zip(words, found) if ids is None}
        if new:
            if len(self.words) + len(new) > REMEMBERED:
                self.words = {"\n": b""}
                new = set(words).difference(self.words)
            self._learn_words(list(new))
            found = [self.words[w] if ids is None else ids for w, ids in zip(words, found)]
        stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        ends = np.append(stop[np.fromiter(map("\n".__eq__, words), bool, len(words))], stop[-1:]).tolist()
        raw = b"".join(found)
        return list(map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def _of(self, chunks: list[str]) -> list[bytes]:
        if not _ODD("\n".join(chunks)):
            return self._plain(chunks)
        plain = list(map(_PLAIN, chunks))
        found = iter(self._plain([c for c, fine in zip(chunks, plain) if fine]))
        other = iter(self._ids(self.whole, [c for c, fine in zip(chunks, plain) if not fine]))
        return [next(found) if fine else next(other).tobytes() for fine in plain]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        line = pc.fill_null(texts, "")
        # fewer distinct chunks; not where a mark could join the lower-case letter only
        line = pc.if_else(pc.match_substring_regex(line, "[^\\x{0}-\\x{2ff}]"), line, pc.ascii_lower(line))
        for space in "\n\t":
            line = pc.replace_substring(line, space, " ")
        cut = pc.split_pattern(line, " ")
        distinct = cut.flatten().dictionary_encode()
        at = distinct.indices.to_numpy()
        raw = self._of(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // ID_BYTES
        start = np.cumsum(size) - size
        total = np.concatenate([[0], np.cumsum(size[at])])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(start[at] - total[:-1], size[at]) + np.arange(total[-1])]
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, names: list[str], capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                line, size = encode(part.column("text"))
                raw, at = line.tobytes(), 0
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, n in enumerate(size.tolist()):
                    own = raw[at : at + n * ID_BYTES] + last
                    at += n * ID_BYTES
                    for p, first in enumerate(range(0, n + 1, capacity)):
                        cut = own[first * ID_BYTES : (first + capacity) * ID_BYTES]
                        of.append(i)
                        piece.append(p)
                        start.append(first)
                        length.append(len(cut) // ID_BYTES)
                        crc.append(zlib.crc32(cut))
                        if keep_ids:
                            ids.append(cut)
                taken = part.take(pa.array(of, pa.int64()))
                new = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                    new["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([new.get(n, taken.column(n) if n in taken.schema.names else None) for n in names], names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    A document is its ids and ``end``, cut into pieces of ``capacity`` ids, the last one shorter. A null or empty text
    is the single id ``end``; white space and unknown characters are as the tokenizer has them; very long texts are cut
    like others. Repeated rows are documents of their own, an empty table gives no rows, and the new columns replace
    columns of their names; put the caller's row into a struct to keep it.
    """
    new = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    schema = with_fields(docs.drop("text").schema, *new, *([StructField("ids", ArrayType(IntegerType()))] if keep_ids else []))
    return docs.mapInArrow(_pieces(path, schema.names, capacity, end, keep_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of ``counts`` pieces of each length, longest first.

    Entries ``(length, low, high, first, each, offset)``: the pieces of a length with ranks from ``low`` to below
    ``high`` go to sequences from ``first`` on, ``each`` to a sequence, the first of them at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, number of sequences)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = min((r for r in room if r >= length), default=0)
            if fit:
                first, number = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            else:
                fit = capacity
                first, number = opened, -(-left // (capacity // length))
                opened += number
            each = fit // length
            # whole sequences take as many as fit, and one takes the rest
            for took, many in ((each, min(number, left // each)), (left % each, 1)):
                if took and many and number:
                    out.append((length, rank, rank + took * many, first, took, capacity - fit))
                    if fit - took * length:
                        room[fit - took * length].append((first, many))
                    rank, left, first, number = rank + took * many, left - took * many, first + many, number - many
                if left >= each:
                    break
            if number:
                room[fit].append((first, number))
    return out


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Columns of ``table`` in a struct ``row``, with ``length``, ``sequence_id`` and ``offset``.

    ``table.length`` must be from 1 to ``capacity`` in every row; other or null lengths are an error. Rows of equal
    lengths are taken in any order, repeated rows take places of their own, an empty table gives no rows, and columns
    of any name travel in ``row``.
    """
    spark = table.sparkSession
    fine = F.col("length").between(1, capacity)
    length = F.when(fine, F.col("length")).otherwise(F.raise_error(F.lit(f"length must be from 1 to {capacity}"))).cast("int")
    # The part of a row and its number there are written with it, so every later step sees the same ones.
    place = F.monotonically_increasing_id()
    rows = written(table.select(F.struct("*").alias("row"), length.alias("length"), F.shiftright(place, 33).alias("part"), place.alias("place")), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    held = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    entries = defaultdict(list)
    for n, *entry in plan(held, capacity):
        entries[n].append(tuple(entry))
    planned = spark.createDataFrame(list(entries.items()), "length int, entries array<struct<low long, high long, first long, each long, offset long>>")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("part", "length", earlier.alias("before"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("place")) - 1
    ranked = rows.withColumn("within", within).join(before, ["part", "length"])
    rank = F.col("before") + F.col("within")
    # planned has one row per length and at most 3 x capacity x log2(capacity) entries in all
    slots = ranked.join(F.broadcast(planned), "length").withColumn("rank", rank)
    slot = F.filter("entries", lambda e: (e["low"] <= F.col("rank")) & (F.col("rank") < e["high"]))[0]
    slots = slots.withColumn("slot", slot).withColumn("turn", F.col("rank") - F.col("slot.low"))
    return slots.select(
        "row", F.col("length").cast("long").alias("length"),
        (F.col("slot.first") + F.floor(F.col("turn") / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.offset") + F.col("turn") % F.col("slot.each") * F.col("length")).alias("offset"),
    )
