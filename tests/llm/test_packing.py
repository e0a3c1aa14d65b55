"""Packing against the tokenizer itself, plain best fit and the rules of a packing."""

import bisect
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import packing
from tidepanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    out = Tokenizer.from_file(FILE)
    out.encode_special_tokens = True
    return out


def best_fit(lengths, capacity) -> int:
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            opened, room = opened + 1, capacity
        else:
            room = rooms.pop(at)
        if room > n:
            bisect.insort(rooms, room - n)
    return opened


def check(placed, capacity) -> int:
    """Number of sequences of ``(sequence, offset, length)``, all gapless from 0 and no longer than ``capacity``."""
    held = {}
    for s, offset, n in placed:
        held.setdefault(s, []).append((offset, n))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit(seed):
    random.seed(seed)
    capacity = random.choice([5, 16, 64, 200])
    counts = {n: random.choice([1, 2, 5, 30, 100]) for n in random.sample(range(1, capacity + 1), random.randint(1, capacity))}
    placed, ranks = [], []
    for n, low, high, first, each, offset in packing.plan(counts, capacity):
        placed += [(first + (r - low) // each, offset + (r - low) % each * n, n) for r in range(low, high)]
        ranks += [(n, r) for r in range(low, high)]
    assert sorted(ranks) == sorted((n, r) for n, c in counts.items() for r in range(c))
    assert check(placed, capacity) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_plan_does_not_grow_with_the_counts():
    counts = {n: 10**9 + n for n in range(1, 2049)}
    assert len(packing.plan(counts)) <= 3 * 2048 * 11


def ids_of(encode, texts):
    ids, size = encode(pa.array(texts))
    stop = np.cumsum(size)
    return [ids[b - n : b].tolist() for n, b in zip(size, stop)]


def test_ids_are_those_of_the_tokenizer(whole):
    random.seed(4)
    pool = [*"abcdeghilmnorstuABCDEIST", *"éÉßñÑÀÿ×÷ªºµ", *"'\"!?.,;:()[]{}<>|/\\-_=+*&^%$#@~`", *"0123456789", *" \t\n\r\x0b\x0c\x1c\x85\xa0 ", *"ΣσςİıǅﬁДд日本語😀é", "́", "'s", "'LL", "<|endoftext|>", "the ", "tion "]
    texts = ["".join(random.choices(pool, k=random.randint(0, 60))) for _ in range(4000)] + ["a" * 5000, "x" * 90 + " " + "é" * 300, "ΑΣ ΑΣ.", "It's WE'RE d'été"]
    texts += [f"x{letter}{chr(mark)}y {letter.upper()}{chr(mark)}" for letter in "abcdefghijklmnopqrstuvwxyz" for mark in range(0x300, 0x370)]
    encode = packing.Encoder(FILE)
    for part in (texts[:2000], texts[2000:], texts[:2000]):
        assert ids_of(encode, part) == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    texts = [" ".join(f"word{i * j % 97}x, Übung{j}" for j in range(30)) for i in range(60)]
    encode = packing.Encoder(FILE)
    for at in range(0, 60, 7):
        part = texts[at : at + 7]
        assert ids_of(encode, part) == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]


def test_edge_rows(spark, whole):
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [(1, None, 5), (2, "", 5), (3, "one", 5), (3, "one", 5), (None, "two three", 5), (4, long, 5)] + [(9, "same text here", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumns({c: F.lit("own") for c in ("offset", "rank", "part", "before", "entries", "row")}).repartition(4)
    cut = packing.pieces(docs, FILE, capacity=64, keep_ids=True)
    out = packing.pack(cut, 64).select("row.doc_id", "row.piece", "row.start", "row.ids", "row.rank", "length", "sequence_id", "offset").collect()
    expected = []
    for doc_id, text, _ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        expected += [(str(doc_id), p, at, ids[at : at + 64]) for p, at in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids"]) for r in out) == sorted(expected)
    assert all(r["length"] == len(r["ids"]) and r["rank"] == "own" for r in out)
    lengths = [r["length"] for r in out]
    assert check([(r["sequence_id"], r["offset"], r["length"]) for r in out], 64) == best_fit(lengths, 64)
    assert packing.pack(packing.pieces(docs.limit(0), FILE)).count() == 0
    for bad in (0, 65, None):
        with pytest.raises(Exception, match="length must be"):
            packing.pack(spark.createDataFrame([(bad,)], "length long"), 64)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
def test_query(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    coded = whole.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)
    expected = []
    for d, e in zip(docs, coded):
        ids = np.array([*e.ids, 0], "<u4")
        expected += [(d["doc_id"], p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    got = QUERIES["op11_packing"](spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    lengths = [r["length"] for r in got]
    assert check([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048) == best_fit(lengths, 2048) <= 1.02 * -(-sum(lengths) // 2048)
