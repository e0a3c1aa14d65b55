"""Language of texts, word by word, by a linear-chain conditional random field.

Every word gets a score for each language from hashed character n-grams, of which those that touch a word's edge are
its affixes, and from lexicons of frequent words. Learned transitions tie the languages of neighbouring words, and
forward-backward gives each word's probabilities, so a text may change its language. A text's language is the one with
the most expected words.

The chains of a slice are cut into pieces of equal length; the transfer matrix of each piece is found for all pieces
at once, and the pieces of a text are then joined, so a very long text costs no more a word than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from tidepanel.llm.common import EDGE, Runs, bucket, letters, slices, with_fields

NO_LANGUAGE = "und"
BITS = 17
GRAMS = (2, 3, 4)
#: Words in a piece of a chain.
PIECE = 64
#: Training: documents for each language at most (bounded sample), words from each, words before the language changes,
#: epochs, words in a lexicon.
SAMPLE, SNIPPET, SWITCH, EPOCHS, LEXICON = 1000, 60, 20, 6, 2000


@dataclass
class Words:
    """The words of a slice of texts: how many each text has, and each word's place among the distinct ones."""

    per_text: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    gram_bucket: np.ndarray = field(repr=False)
    gram_count: np.ndarray = field(repr=False)


def read_words(texts: list[str | None]) -> Words:
    codes, text_end = letters([t or "" for t in texts], 1)
    inside = codes != EDGE
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    per_text = np.diff(np.searchsorted(start, np.concatenate([[0], text_end]), side="right"))
    run = Runs(codes)
    hashes, first, which = np.unique(run(start, end - start), return_index=True, return_inverse=True)
    lo, size = start[first] - 1, end[first] - start[first] + 2
    parts, counts = [], np.zeros(len(first), np.int64)
    for n in GRAMS:
        number = np.maximum(size - n + 1, 0)
        ends = np.cumsum(number)
        at = np.repeat(lo - (ends - number), number) + np.arange(int(ends[-1]) if len(ends) else 0)
        parts.append((ends, number, bucket(run(at, n), n, BITS)))
        counts += number
    # the n-grams of a word side by side
    cells = np.empty(int(counts.sum()), np.int64)
    place = np.cumsum(counts) - counts
    for ends, number, values in parts:
        cells[np.repeat(place - (ends - number), number) + np.arange(len(values))] = values
        place = place + number
    return Words(per_text, which.ravel(), hashes, cells, counts)


@dataclass
class Chain:
    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray
    lexicon_weight: np.ndarray
    switch: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Score of each distinct word for each language; the n-grams count by their mean."""
        sums = np.zeros((len(words.hashes), len(self.labels)), np.float32)
        ends = np.cumsum(words.gram_count)
        some = words.gram_count > 0
        if some.any():
            sums[some] = np.add.reduceat(self.grams[words.gram_bucket], (ends - words.gram_count)[some], axis=0)
        return sums + self.in_lexicons(words.hashes) @ self.lexicon_weight

    def in_lexicons(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.labels)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.lexicon_of[at] * (self.lexicon[at] == hashes)[:, None]

    def expected(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and the expected number in each language."""
        words = read_words(texts)
        scores = self.scores(words)
        weight = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        gamma, _, of_piece = forward_backward(weight[words.which], words.per_text, np.exp(self.switch))
        out = np.zeros((len(texts), len(self.labels)))
        np.add.at(out, of_piece, gamma.sum(axis=1))
        return words.per_text, out


def _norm(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-30)


def forward_backward(weight: np.ndarray, lens: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors by (piece, place in the piece, label), zero where a piece is not full; the same from the words so far only; and the text of each piece.

    ``weight`` has the emission weights of all words, texts end to end, ``switch`` the transition weights; a chain
    starts from an even mixture.
    """
    k = switch.shape[0]
    pieces = -(-lens // PIECE)
    first = np.cumsum(pieces) - pieces
    text = np.repeat(np.arange(len(lens)), pieces)
    nth = np.arange(len(text)) - first[text]
    base = (np.cumsum(lens) - lens)[text] + nth * PIECE
    held = np.minimum(lens[text] - nth * PIECE, PIECE)
    filled = np.arange(PIECE) < held[:, None]
    emit = np.where(filled[..., None], weight[np.where(filled, base[:, None] + np.arange(PIECE), 0)], 1).astype(np.float32) if len(text) else np.zeros((0, PIECE, k), np.float32)
    switch = switch.astype(np.float32)
    transfer = np.broadcast_to(np.eye(k, dtype=np.float32), (len(text), k, k)).copy()
    for t in range(PIECE):
        step = _norm((transfer @ switch) * emit[:, t, None, :], (1, 2))
        transfer = np.where(filled[:, t, None, None], step, transfer)
    ahead, behind = np.full((len(text), k), 1 / k, np.float32), np.ones((len(text), k), np.float32)
    most = int(pieces.max()) if len(pieces) else 0
    for j in range(1, most):
        at = first[pieces > j] + j
        ahead[at] = _norm(np.einsum("ca,cab->cb", ahead[at - 1], transfer[at - 1]), 1)
        at = (first + pieces - 1)[pieces > j] - j
        behind[at] = _norm(np.einsum("cab,cb->ca", transfer[at + 1], behind[at + 1]), 1)
    alpha = np.empty_like(emit)
    now = ahead
    for t in range(PIECE):
        now = np.where(filled[:, t, None], _norm((now @ switch) * emit[:, t], 1), now)
        alpha[:, t] = now
    gamma = np.zeros_like(alpha)
    now = behind
    for t in range(PIECE - 1, -1, -1):
        before = _norm((emit[:, t] * now) @ switch.T, 1)
        gamma[:, t] = np.where(filled[:, t, None], alpha[:, t] * now, 0)
        now = np.where(filled[:, t, None], before, now)
    return _norm(gamma, 2), alpha, text


def train(samples: list[tuple[str, str]], seed: int = 7) -> Chain | None:
    """Fit a chain to (label, text) samples by AdaGrad on the exact gradient of the chain's likelihood."""
    labels = sorted({label for label, _ in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    words = read_words([t for _, t in samples])
    number = {label: i for i, label in enumerate(labels)}
    label = np.repeat([number[x] for x, _ in samples], words.per_text)
    k, n = len(labels), len(words.hashes)
    seen = np.zeros((n, k))
    np.add.at(seen, (words.which, label), 1)
    common = [np.argsort(-seen[:, i], kind="stable")[:LEXICON] for i in range(k)]
    listed = np.unique(np.concatenate(common)) if n else np.zeros(0, np.int64)
    share = seen[listed] / np.maximum(seen[listed].sum(axis=1, keepdims=True), 1)
    chain = Chain(labels, np.zeros((1 << BITS, k), np.float32), words.hashes[listed], ((seen[listed] >= 2) * share).astype(np.float32), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32))
    runs = []  # (first word, words) of runs of one language, dealt anew into chains in each epoch
    for at, size in zip(np.cumsum(words.per_text) - words.per_text, words.per_text):
        runs += [(at + i, min(SWITCH, size - i)) for i in range(0, size, SWITCH)]
    gram_at = np.cumsum(words.gram_count) - words.gram_count
    member = chain.in_lexicons(words.hashes)
    power = [np.full_like(x, 1e-2) for x in (chain.grams, chain.lexicon_weight, chain.switch)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for b in range(0, len(order), 192):
            batch = [runs[i] for i in order[b : b + 192]]
            lens = np.array([sum(r[1] for r in batch[i : i + 3]) for i in range(0, len(batch), 3)])
            at = np.concatenate([np.arange(s, s + m) for s, m in batch])
            kinds, place = np.unique(words.which[at], return_inverse=True)
            count = words.gram_count[kinds]
            ends = np.cumsum(count)
            cells = words.gram_bucket[np.repeat(gram_at[kinds] - (ends - count), count) + np.arange(int(ends[-1]))]
            scores = np.add.reduceat(chain.grams[cells], ends - count, axis=0) + member[kinds] @ chain.lexicon_weight
            weight = np.exp(scores - scores.max(axis=1, keepdims=True))[place]
            switch = np.exp(chain.switch)
            gamma, alpha, _ = forward_backward(weight, lens, switch)
            flat, before = (x.reshape(-1, k)[_cells(lens)] for x in (gamma, alpha))
            truth = np.eye(k, dtype=np.float32)[label[at]]
            error = (truth - flat).astype(np.float32)
            by_kind = np.zeros((len(kinds), k), np.float32)
            np.add.at(by_kind, place, error)
            touched, of = np.unique(cells, return_inverse=True)
            spread = np.repeat(by_kind, count, axis=0)
            grad = np.stack([np.bincount(of.ravel(), spread[:, i], len(touched)) for i in range(k)], axis=1).astype(np.float32)
            inner = np.ones(len(at), bool)
            inner[np.cumsum(lens) - lens] = False
            nxt = np.flatnonzero(inner)
            pair = before[nxt - 1][:, :, None] * switch * (flat[nxt] / np.maximum(before[nxt - 1] @ switch, 1e-30))[:, None, :]
            moved = np.zeros((k, k), np.float32)
            np.add.at(moved, (label[at][nxt - 1], label[at][nxt]), 1)
            for value, total, step, where in (
                (chain.grams, power[0], grad, touched),
                (chain.lexicon_weight, power[1], member[kinds].T @ by_kind, slice(None)),
                (chain.switch, power[2], moved - pair.sum(axis=0), slice(None)),
            ):
                total[where] += step**2
                value[where] += 0.1 * step / np.sqrt(total[where]) - 1e-5 * value[where]
    return chain


def _cells(lens: np.ndarray) -> np.ndarray:
    """Places of the words of chains with ``lens`` words in the flattened (piece, place) table."""
    pieces = -(-lens // PIECE)
    first = (np.cumsum(pieces) - pieces) * PIECE
    ends = np.cumsum(lens)
    return np.repeat(first - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def learn(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Chain | None:
    """Fit a chain to a bounded sample: ``SAMPLE`` documents of each label, ``SNIPPET`` words from a seeded place.

    Rows without label or text are left out; without any rows there is no chain.
    """
    ids = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"))
    turn = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = ids.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= SAMPLE).select("id").distinct()
    words = F.split(F.col("text"), r"\s+")
    start = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.size("words") - SNIPPET)).cast("int") + 1
    rows = docs.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(text).alias("text")).join(chosen, "id").filter("label is not null and text is not null")
    rows = rows.withColumn("words", words).select("label", F.array_join(F.slice("words", start, SNIPPET), " ").alias("text"))
    return train(sorted(map(tuple, rows.collect())))


def predict(df: DataFrame, chain: Chain | None, text: str = "text") -> DataFrame:
    """Append ``lang_pred``, the language with most expected words, and ``score``, its share of the words.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no chain.
    """
    held = df.sparkSession.sparkContext.broadcast(chain)  # 2^BITS cells for each label, and the lexicons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in slices(batch, text):
                names, score = [NO_LANGUAGE] * part.num_rows, np.zeros(part.num_rows)
                if model:
                    number, expected = model.expected(part.column(text).to_pylist())
                    some = number > 0
                    best = expected.argmax(axis=1)
                    score[some] = np.clip(expected[some, best[some]] / number[some], 0, 1)
                    names = [model.labels[b] if s else NO_LANGUAGE for b, s in zip(best, some)]
                keep = [n for n in part.schema.names if n.lower() not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return df.mapInArrow(run, with_fields(df.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())))


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by a chain fitted to ``labelled``."""
    return predict(docs, learn(labelled, text, label, key), text)
