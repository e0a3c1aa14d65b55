"""Leading singular vectors of whole panels over calendars of any length, by block steps with Rayleigh-Ritz.

Let Z be the standardised panel, series by periods. One step multiplies a block Q of period vectors by Z'Z: every bucket
of series computes its part of Z'(ZQ), periods x block cells, and the parts are summed by period. The T x T matrix is
never formed. Per panel, the blocks so far span a space of period vectors; its best approximations to the singular
vectors (Ritz vectors) and their residuals follow from small matrices, and the residuals give the next block. The space
is cut back to the best vectors before it grows beyond ``SPACES`` blocks. It ends when all wanted residuals are below
``tol`` or the space is the whole one, so short calendars end after few steps with exact results.

The series are dealt into buckets and checkpointed once; later steps shuffle only blocks and sums. A calendar of at
most ``WHOLE`` periods starts with the whole space, so that a single step gives its exact result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage, spread

#: Columns of a block beyond the wanted vectors, and blocks that a space may hold.
EXTRA, SPACES = 16, 6
#: Columns of the first block of a short calendar.
WHOLE = 128
#: Wanted vectors count as found when their residuals, relative to the largest eigenvalue, are below ``TOL``.
TOL, MOST_STEPS = 1e-11, 200

STATE = (
    "panel_id string, m int, n_series long, total double, counts array<double>, v array<double>, av array<double>, "
    "q array<double>, found array<double>, vectors array<double>, steps int, residual double"
)


def columns(m: int, k: int) -> int:
    """Columns of a block for ``m`` periods and ``k`` wanted vectors."""
    return m if m <= WHOLE else min(m, k + EXTRA)


def start_block(m: int, p: int) -> np.ndarray:
    """Orthonormal first block: waves over the calendar, from slow to fast; the whole space if it has ``m`` columns."""
    if p >= m:
        return np.eye(m)
    return np.linalg.qr(np.cos(np.pi * np.arange(1, p + 1)[None, :] * (np.arange(m)[:, None] + 0.5) / m))[0]


def bucketed(z: DataFrame, number: int | None = None) -> DataFrame:
    """``(panel_id, series, z, ...)`` with a ``bucket`` of its panel, dealt by both and checkpointed.

    Every panel has as many buckets as there are shuffle partitions, so one holds that share of its series.
    """
    number = number or int(z.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = z.withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(number)).cast("int"))
    return cut_lineage(spread(buckets, "panel_id", "bucket"))


SUMS = "panel_id string, t int, j int, y double"


def _parts(k: int, first: bool):
    """A bucket's part of Z'(ZQ), as cells ``(t, j, y)``. The first time also the number of cells seen per period
    (``j`` is -1), of usable series, and their sum of squares (``t`` is -1)."""

    def run(series: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(series) or (not first and not len(block)):
            return pd.DataFrame(columns=["panel_id", "t", "j", "y"])
        usable = series["usable"].to_numpy(bool)
        m = len(series["seen"].iloc[0])
        z = np.array(list(series["z"][usable]), dtype=float).reshape(-1, m)
        q = start_block(m, columns(m, k)) if first else np.asarray(block["q"].iloc[0], dtype=float).reshape(m, -1)
        y = z.T @ (z @ q)
        t, j = (i.ravel() for i in np.indices(y.shape))
        cells = [t], [j], [y.ravel()]
        if first:
            cells[0].append(np.append(np.arange(m), [-1, -1]))
            cells[1].append(np.append(np.full(m, -1), [0, 1]))
            cells[2].append(np.append(np.array(list(series["seen"]), dtype=float).sum(axis=0), [len(z), (z**2).sum()]))
        t, j, y = map(np.concatenate, cells)
        return pd.DataFrame({"panel_id": series["panel_id"].iloc[0], "t": t, "j": j, "y": y})

    return run


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthonormal and free of ``against``; those that vanish are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def _advance(k: int, tol: float):
    """The state of a panel after one more product."""

    def run(sums: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(sums):
            return states
        t, j, y = (sums[c].to_numpy() for c in ("t", "j", "y"))
        m = int(t.max()) + 1
        cell = (t >= 0) & (j >= 0)
        av_new = np.zeros((m, int(j.max()) + 1))
        av_new[t[cell], j[cell]] = y[cell]
        p = columns(m, k)
        if len(states):
            state = states.iloc[0].to_dict()
            q, v, av = (np.asarray(state[c], dtype=float).reshape(m, -1) for c in ("q", "v", "av"))
        else:
            head = dict(zip(j[t < 0], y[t < 0]))
            counts = np.zeros(m)
            counts[t[(t >= 0) & (j < 0)]] = y[(t >= 0) & (j < 0)]
            q, v, av = start_block(m, p), np.zeros((m, 0)), np.zeros((m, 0))
            state = {"panel_id": sums["panel_id"].iloc[0], "m": m, "n_series": int(head[0]), "total": float(head[1]), "counts": counts.tolist(), "steps": 0}
        v, av = np.hstack([v, q]), np.hstack([av, av_new])
        small = v.T @ av
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        x, ax = v @ turn, av @ turn
        rest = ax[:, :p] - x[:, :p] * values[:p]
        off = float(np.linalg.norm(rest[:, :k], axis=0).max(initial=0.0)) / max(values[0], 1e-300)
        wanted = min(k, v.shape[1])
        done = off <= tol or v.shape[1] >= m or state["steps"] + 1 >= MOST_STEPS
        block = np.zeros((m, 0)) if done else _orthonormal(rest, v)
        if block.shape[1] and v.shape[1] + block.shape[1] > SPACES * p:
            v, av = x[:, : 2 * p], ax[:, : 2 * p]
        if not block.shape[1]:
            v = av = np.zeros((m, 0))
        state |= {"v": v.ravel().tolist(), "av": av.ravel().tolist(), "q": block.ravel().tolist(), "found": values[:wanted].tolist(),
                  "vectors": x[:, :wanted].T.ravel().tolist(), "steps": state["steps"] + 1, "residual": off}
        return pd.DataFrame([state])[[c.split()[0] for c in STATE.split(", ")]]

    return run


def leading(z: DataFrame, k: int, tol: float = TOL) -> DataFrame:
    """Eigenvalues and vectors of Z'Z of every panel, the ``k`` largest, as ``STATE`` rows: ``found`` has the values,
    ``vectors`` the vectors one after the other; ``residual`` tells how exact they are.

    ``z`` has ``(panel_id, series, usable, z, seen)``: an array per series, 0 for a missing cell, NULL if the series is
    not usable, and which cells were observed.
    """
    spark = z.sparkSession
    buckets = bucketed(z)
    state = spark.createDataFrame([], STATE)
    blocks = spark.createDataFrame([], "panel_id string, bucket int, q array<double>")
    first = True
    while True:
        parts = buckets.groupBy("panel_id", "bucket").cogroup(blocks.groupBy("panel_id", "bucket")).applyInPandas(_parts(k, first), SUMS)
        sums = parts.groupBy("panel_id", "t", "j").agg(F.sum("y").alias("y"))
        state = cut_lineage(sums.groupBy("panel_id").cogroup(state.groupBy("panel_id")).applyInPandas(_advance(k, tol), STATE))
        open_ = state.filter(F.size("q") > 0)
        if open_.isEmpty():
            return state
        if first:
            numbers = buckets.select(*[F.col(c).alias(c) for c in ("panel_id", "bucket")]).distinct()
            first = False
        blocks = open_.select("panel_id", "q").join(numbers, "panel_id")
