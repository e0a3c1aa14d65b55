"""Toxicity of texts by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its lower-cased letters that it has, with other characters as edges. The ratio of
an n-gram compares how many toxic and other texts have it; n-grams whose counts a likelihood-ratio test, which is
valid for zero counts, finds within noise are left out, and a logistic regression weighs the ratios of the rest. Only few n-grams keep a weight, so scoring looks up every n-gram of
a text and sums the few that count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tidepanel.llm.common import Runs, bucket, letters, slices, with_fields

GRAMS = (3, 4, 5)
BITS = 22
#: The classifier is fitted to at most so many labelled texts, in a seeded order, with at most so many characters. Each
#: label may take half of both, and what the other leaves.
SAMPLE, SAMPLE_CHARS = 8000, 40_000_000
#: A ratio counts if the likelihood-ratio statistic of its counts (chi-squared, one degree of freedom) is at least this.
TELLING = 10.83
STEPS, RATE, RIDGE = 300, 0.1, 1e-4


@dataclass
class Classifier:
    cells: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        flag = np.zeros(1 << BITS, bool)
        flag[self.cells] = True
        text, cell = grams(texts, flag)
        total = np.bincount(text, self.weight[np.searchsorted(self.cells, cell)], len(texts)) if len(cell) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.bias + total)))


def grams(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell): the cells of the n-grams that each text has, once each; only ``wanted`` ones if given."""
    codes, ends = letters([t or "" for t in texts], max(GRAMS))
    run = Runs(codes)
    keys = []
    for n in GRAMS:
        cell = bucket(run.every(n), n, BITS)
        at = np.flatnonzero(wanted[cell]) if wanted is not None else np.arange(len(cell))
        keys.append((np.searchsorted(ends, at, side="left").clip(max=len(texts) - 1) << BITS) | cell[at])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def deviance(p: np.ndarray, q: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood-ratio statistic of an n-gram in ``p`` of ``n1`` toxic and ``q`` of ``n0`` other texts."""
    share = (p + q) / (n1 + n0)
    out = np.zeros(len(p))
    for seen, n, part in ((p, n1, share), (q, n0, share), (n1 - p, n1, 1 - share), (n0 - q, n0, 1 - share)):
        own = seen > 0
        out[own] += 2 * seen[own] * np.log(seen[own] / (n * part[own]))
    return out


class Packed:
    """Sorted cells of each text, packed; unpacked one text at a time, as often as they are gone through."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __iter__(self) -> Iterator[np.ndarray]:
        return (np.cumsum(np.frombuffer(zlib.decompress(x), np.int32), dtype=np.int32) for x in self.packed)

    @staticmethod
    def pack(cells: np.ndarray) -> bytes:
        return zlib.compress(np.diff(cells, prepend=0).astype(np.int32).tobytes(), 1)


def train(features: Iterable[np.ndarray], toxic: np.ndarray, odds: float = 1.0) -> Classifier:
    """Fit to texts given by the cells that they have, and whether each is toxic.

    ``odds``: how many times the odds of a toxic text in the sample the odds among all texts are.
    """
    toxic = toxic.astype(float)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), bias + float(np.log(odds)))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, mark in zip(features, toxic):  # a text has each of its cells once
        (p if mark else q)[own] += 1
    ratio = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))
    seen = np.flatnonzero(p + q)
    cells = seen[deviance(p[seen], q[seen], n1, n0) >= TELLING]
    place = np.full(1 << BITS, -1)
    place[cells] = np.arange(len(cells))
    columns = [c[c >= 0] for c in (place[own] for own in features)]
    text, column = np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate(columns)
    scale = ratio[cells]
    weight = np.zeros(len(cells) + 1)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    weight[-1] = bias
    for step in range(1, STEPS + 1):
        margin = np.bincount(text, (weight[:-1] * scale)[column], len(toxic)) + weight[-1]
        error = 1 / (1 + np.exp(-margin)) - toxic
        slope = np.append(np.bincount(column, error[text], len(cells)) * scale / len(toxic) + RIDGE * weight[:-1], error.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weight -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Classifier(cells, weight[:-1] * scale, float(weight[-1] + np.log(odds)))


def fitting(sizes: list[int], limit: int) -> list[int]:
    """Places of the texts to take, in order, within ``limit`` characters; a text that does not fit is passed over."""
    out, held = [], 0
    for i, n in enumerate(sizes):
        if held + n <= limit:
            out.append(i)
            held += n
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Classifier:
    """Fit to the documents of ``docs`` that ``labels`` marks 0 or 1, at most ``SAMPLE`` of them, rare labels first.

    Tasks turn the texts into cells; only those come to the driver. A document with several labels counts with the
    largest. Without labels of both kinds only the bias is left.
    """
    marked = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    rows = docs.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n")).join(marked, "id")
    order = [F.xxhash64("id"), F.col("id")]
    number = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, taken, left, chars = [], {}, SAMPLE, SAMPLE_CHARS
    for k, mark in enumerate(sorted(number, key=lambda x: (number[x], x))):  # the label with fewer texts first
        share = len(number) - k
        found = rows.filter(F.col("toxic") == mark).orderBy(*order).limit(left // share).select("id", "n", "toxic").collect()
        found = [found[i] for i in fitting([r["n"] for r in found], chars // share)]
        few, taken[mark] = few + found, len(found)
        left, chars = left - len(found), chars - sum(r["n"] for r in found)
    odds = (number[1] / taken[1]) / (number[0] / taken[0]) if all(taken.get(x) for x in (0, 1)) else 1.0
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["toxic"]) for r in few], "id long, toxic int").distinct() if few else None
    if chosen is None:
        return train([], np.zeros(0))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                of, cell = grams(part.column("text").to_pylist())
                cut = np.searchsorted(of, np.arange(part.num_rows + 1))
                values = [Packed.pack(cell[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), pa.array(values, pa.binary())], ["id", "toxic", "cells"])

    found = sorted(texts.mapInArrow(run, "id long, toxic int, cells binary").collect())
    return train(Packed([r["cells"] for r in found]), np.array([r["toxic"] for r in found], float), odds)


def score(df: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``, the probability (0 to 1) that the whole ``text`` is toxic; a null text counts as empty."""
    held = df.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                values = held.value.score(part.column(text).to_pylist())
                keep = [n for n in part.schema.names if n.lower() != out.lower()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(values)], [*keep, out])

    return df.mapInArrow(run, with_fields(df.schema, StructField(out, DoubleType())))
