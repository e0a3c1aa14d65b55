"""Byte-level BPE: encoding in length-bucketed matrices, and decoding.

A text is cut into chunks at white space, each distinct chunk is split by the tokenizer's pattern, and each distinct
piece is encoded once. Pieces of like length
form a matrix with one row per piece and one id per byte, padded at the right. Each round looks up the rank of every
adjacent pair in a hash table, merges in every row the leftmost pair of minimum rank, closes the gap, and takes the
rows without a known pair out of the matrix. Pieces longer than the widest bucket are merged by a heap, with the same
result in O(n log n).
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from tidepanel.llm.common import slices, with_fields

#: What a task does with its batches, and the column that this appends.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], StructField]

NO_RANK = np.int32(2**31 - 1)
WIDEST = 256
#: Distinct chunks that a task remembers; it forgets all of them when there are more.
REMEMBERED = 600_000
#: Chunks of a text: a run without white space and the one space before it, or white space. The split patterns of
#: byte-level vocabularies never look past a chunk, so a chunk's pieces depend on the chunk alone.
CHUNK = re.compile(r" ?[^\s\x1c-\x1f]+|\s+(?!\S)|\s+").findall
#: Control characters that the two regular expression libraries class differently as white space.
UNCLEAR = re.compile(r"[\x1c-\x1f]").search


class PairRanks:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = first[free[first]]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a pair with a padding side (-1) or without a rank has ``NO_RANK``."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(keys), NO_RANK, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[open_])
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out


def _starts(count: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where each piece begins when pieces of ``count`` cells are laid out in ``order``."""
    at = np.empty(len(count), np.int64)
    at[order] = np.cumsum(count[order]) - count[order]
    return at


def _gather(values: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + len]``, end to end."""
    ends = np.cumsum(lens)
    return values[np.repeat(start - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Tokenizer:
    """Ranks of a tiktoken file, the split pattern, and the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.pair = PairRanks((left << 32) | right, rank.astype(np.int32))
        by_rank = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.token_len = np.array([len(t) for t in by_rank], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _long(self, piece: bytes) -> np.ndarray:
        """One piece by a heap of (rank, place) over a doubly linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.pair(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i) for i, r in enumerate(rank) if r < NO_RANK]
        heapq.heapify(heap)
        current = dict((i, r) for r, i in heap)
        one = lambda a, b: int(self.pair(np.array([a]), np.array([b]))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if current.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            current.pop(j, None)
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    new = one(ids[k], ids[after[k]]) if after[k] < n else NO_RANK
                    current[k] = new
                    if new < NO_RANK:
                        heapq.heappush(heap, (new, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _matrix(self, pieces: list[bytes], width: int) -> np.ndarray:
        """Ids of pieces of at most ``width`` bytes, a row each, filled up with -1."""
        lens = np.array([len(p) for p in pieces])
        cells = self.byte_id[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)].reshape(-1, width)
        cells = np.where(np.arange(width) < lens[:, None], cells, -1)
        cells = np.hstack([cells, np.full((len(cells), 1), -1, np.int32)])
        ranks = self.pair(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(-1, width)
        row, out = np.arange(len(pieces)), np.empty_like(cells)
        columns = np.arange(width)
        while len(row):
            place = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), place]
            go = best < NO_RANK
            if not go.all():
                out[row[~go]] = cells[~go]
                row, cells, ranks, place, best = row[go], cells[go], ranks[go], place[go], best[go]
            at = np.arange(len(row))
            behind = columns > place[:, None]
            np.copyto(cells[:, :-1], cells[:, 1:].copy(), where=behind)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=behind[:, :-1])
            cells[at, place], cells[:, -1], ranks[:, -1] = best, -1, NO_RANK
            ranks[at, place] = self.pair(best, cells[at, place + 1])
            inner = np.flatnonzero(place > 0)
            ranks[inner, place[inner] - 1] = self.pair(cells[inner, place[inner] - 1], best[inner])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids of all pieces."""
        size = np.array([len(p) for p in pieces], np.int64)
        width = np.array([n + n % 2 if n <= 32 else 1 << (n - 1).bit_length() for n in size.tolist()])
        count, order, flat = np.zeros(len(pieces), np.int64), [], []
        for w in np.unique(width):
            where = np.flatnonzero(width == w)
            step = max(1, 4_000_000 // int(w)) if w <= WIDEST else 1
            for k in range(0, len(where), step):
                part = where[k : k + step]
                cells = self._matrix([pieces[i] for i in part], int(w)) if w <= WIDEST else self._long(pieces[part[0]])[None]
                count[part] = (cells >= 0).sum(axis=1)
                order.append(part)
                flat.append(cells[cells >= 0])
        return count, _gather(np.concatenate(flat), _starts(count, np.concatenate(order)), count) if flat else np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text into the ids, and the ids of all texts."""
        cut = [[t] if UNCLEAR(t) else CHUNK(t) for t in texts]
        chunks = [c for s in cut for c in s]
        if len(self.index) > REMEMBERED:
            self.forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        if new:
            split = [self.split(c) for c in new]
            pieces = [p for s in split for p in s]
            known = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            count, ids = self.encode_pieces([p.encode() for p in known])
            which = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            ends = np.concatenate([[0], np.cumsum(count[which])])
            bounds = ends[np.cumsum([0] + [len(s) for s in split])]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.len = np.concatenate([self.len, np.diff(bounds)])
            self.ids = np.concatenate([self.ids, _gather(ids, (np.cumsum(count) - count)[which], count[which])])
        which = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        lens = self.len[which]
        of_text = np.cumsum([0] + [len(s) for s in cut])
        return np.concatenate([[0], np.cumsum(lens)])[of_text].astype(np.int32), _gather(self.ids, (np.cumsum(self.len) - self.len)[which], lens)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text into the bytes, and the bytes of all texts."""
        lens = self.token_len[ids]
        return np.concatenate([[0], np.cumsum(lens)])[offsets].astype(np.int32), _gather(self.token_bytes, self.token_at[ids], lens)


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], [*keep, name])


def encoding(path: str, pattern: str, text: str = "text", out: str = "ids") -> Step:
    """The step of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, text):
                    offsets, ids = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                    yield _with(part, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
        finally:
            bpe.forget()  # the worker lives on, idle or in other stages

    return run, StructField(out, ArrayType(IntegerType()))


def decoding(path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> Step:
    """The step of ``decode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column(ids).fill_null(pa.scalar([], part.column(ids).type)) if part.column(ids).null_count else part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                ends, data = bpe.decode(offsets, flat)
                values = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield _with(part, out, values)

    return run, StructField(out, BinaryType())


def steps(df: DataFrame, *made: Step) -> DataFrame:
    """Append the columns of all steps, in their order, in one pass.

    A slice goes from step to step inside its Python worker. Steps applied one by one hold a worker each in every task,
    and whole batches of all columns between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _ in made:
            batches = step(batches)
        return batches

    schema = df.schema
    for _, field in made:
        schema = with_fields(schema, field)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append ``out``, the token ids of the whole ``text`` as array<int>; no special tokens.

    A null or empty text has no ids. Rows and all other columns stay as they are; a column already named ``out`` is
    replaced. ``path`` is a rank file that every executor can open.
    """
    return steps(df, encoding(path, pattern, text, out))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``, the bytes that ``ids`` stand for; null or no ids give no bytes."""
    return steps(df, decoding(path, pattern, ids, out))
