"""Factor models of whole panels.

The singular vectors of a whole standardised panel come from subspace.py, for calendars of any length. Those of
rolling windows come from the cross-moment matrix of each window, which is a sum over series: each task adds up the part
of its own series, the parts are summed by a shuffle keyed by cell, and only the finished matrix of one window meets in
one place. Loadings and forecasts are then made next to each series. No panel is ever gathered. Rolling windows are cut
from the packed series inside the tasks, so a row is not copied once per window it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import shifted
from tidepanel.functions.panelmath import as_block, last_two, level_rows, ready_rows, scale_rows, stationary_rows, stream
from tidepanel.operators.simulate import factor_paths
from tidepanel.operators.subspace import leading
from tidepanel.panel import KEYS
from tidepanel.session import spread

MAX_WINDOW = 4096  # periods; a cross-moment matrix has this many rows at most
FLUSH_CELLS = 16_000_000  # partial matrix cells a task holds before it hands them on
FLOOR = 0.01  # least deviation of residuals

MODEL = (
    "panel_id string, origin int, start int, width int, k int, n_series long, n_rows long, total double, "
    "s array<double>, u array<double>, scores array<double>, path array<double>, c array<double>, phi array<double>, "
    "sigma array<double>, f_prev array<double>, f_last array<double>, status string"
)
PARTIAL = "panel_id string, origin int, start int, width int, i int, j int, g double"


@dataclass(frozen=True)
class FactorSpec:
    """What to fit on every window.

    ``prepare``: ``pca`` (observed cells standardised, missing ones at their mean, series with ``min_obs``
    observations) or ``ready`` (model-ready panel, series with a share of ``min_obs_ratio`` observed).
    ``dynamics``: ``var`` of the given order, ``ar1`` per factor, or ``decay`` with a fixed persistence.
    ``window``: periods per window, 0 for the whole panel; ``horizon`` periods must follow a rolling window.
    """

    k: int = 2
    prepare: str = "pca"
    min_obs: int = 100
    min_obs_ratio: float = 0.8
    rule: str = "short"
    dynamics: str = "var"
    order: int = 1
    persistence: float = 0.9
    horizon: int = 12
    window: int = 0
    ddof: int = 1
    freq: str = "month"

    def windows(self, n: int) -> list[tuple[int, int, int]]:
        if not self.window:
            return [(0, 0, n)]
        return [(o, o, self.window) for o in range(n - self.window - self.horizon + 1)]


def pack_levels(panel: DataFrame, freq: str = "month") -> DataFrame:
    """One row per series: all its periods as an array (missing ones NULL), code and first date, for hours first time."""
    rows = panel.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_rows"), F.max("tcode").alias("tcode"), F.min("ds").alias("first_ds")
    )
    return rows.select(*KEYS, "tcode", F.col("first_ds").cast("timestamp" if freq == "hour" else "date").alias("first_ds"), F.transform("_rows", lambda r: r["value"]).alias("v"))


def _days(first, n: int, freq: str) -> np.ndarray:
    if freq == "month":
        return (np.datetime64(first, "M") + np.arange(n)).astype("datetime64[D]").astype(float)
    return np.arange(n, dtype=float)


def prepared(v: np.ndarray, codes: np.ndarray, days: np.ndarray, spec: FactorSpec):
    """(z with 0 for missing, seen mask, mean, deviation, usable rows, rows cut at the start) of one window."""
    x = stationary_rows(v, codes)
    if spec.prepare == "ready":
        z, mu, sd, usable = ready_rows(x, spec.min_obs_ratio, spec.rule, days)
        return np.where(np.isnan(z), 0.0, z), np.ones(z.shape, bool), mu, sd, usable, 2
    z, mu, sd = scale_rows(x, spec.ddof)
    seen = ~np.isnan(x)
    varies = np.nanmax(np.where(seen, x, -np.inf), axis=1) > np.nanmin(np.where(seen, x, np.inf), axis=1)
    usable = (seen.sum(axis=1) >= spec.min_obs) & varies
    return np.where(seen, z, 0.0), seen, mu, sd, usable, 0


def _partial_moments(spec: FactorSpec):
    """Task side: the part of every window's cross-moment matrix that comes from the task's own series.

    Besides the upper triangle, cell (i, -1) counts the observations at period i and (-1, -1) the usable series.
    """

    def emit(key, entry) -> pd.DataFrame:
        gram, counts, n = entry
        i, j = np.triu_indices(len(gram))
        keep = gram[i, j] != 0
        rows = pd.DataFrame({
            "i": np.concatenate([i[keep], np.arange(len(gram)), [-1]]),
            "j": np.concatenate([j[keep], np.full(len(gram) + 1, -1)]),
            "g": np.concatenate([gram[i, j][keep], counts, [n]]),
        })
        for name, value in zip(("panel_id", "origin", "start", "width"), key):
            rows[name] = value
        return rows[["panel_id", "origin", "start", "width", "i", "j", "g"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        cells = 0
        for batch in batches:
            for (panel, n), part in batch.assign(n=batch["v"].map(len)).groupby(["panel_id", "n"]):
                block, codes = as_block(part["v"], n), part["tcode"].to_numpy()
                days = _days(part["first_ds"].iloc[0], n, spec.freq)
                for origin, start, width in spec.windows(n):
                    if width > MAX_WINDOW:
                        raise ValueError(f"window of {width} periods; choose a coarser calendar or a shorter window")
                    cut = slice(start, start + width)
                    z, seen, _, _, usable, _ = prepared(block[:, cut], codes, days[cut], spec)
                    key = (panel, origin, start, width)
                    if key not in held:
                        m = z.shape[1]
                        held[key] = [np.zeros((m, m)), np.zeros(m), 0]
                        cells += m * m
                    held[key][0] += z[usable].T @ z[usable]
                    held[key][1] += seen.sum(axis=0)
                    held[key][2] += int(usable.sum())
                    if cells > FLUSH_CELLS:
                        for key, entry in held.items():
                            yield emit(key, entry)
                        held, cells = {}, 0
        for key, entry in held.items():
            yield emit(key, entry)

    return run


def cross_moments(packed: DataFrame, spec: FactorSpec) -> DataFrame:
    """Cross-moment cells ``(i, j, g)`` of every window, summed over the series of a panel."""
    parts = packed.select("panel_id", "tcode", "first_ds", "v").mapInPandas(_partial_moments(spec), PARTIAL)
    return parts.groupBy("panel_id", "origin", "start", "width", "i", "j").agg(F.sum("g").alias("g"))


def _var_path(f: np.ndarray, order: int, horizon: int) -> np.ndarray:
    """Vector autoregression with constant by least squares; forecasts as (horizon, K)."""
    t, k = f.shape
    design = np.column_stack([np.ones(t - order)] + [f[order - i : t - i] for i in range(1, order + 1)])
    coef = np.linalg.lstsq(design, f[order:], rcond=None)[0]
    history = list(f[-order:])
    for _ in range(horizon):
        row = np.concatenate([[1.0]] + [history[-i] for i in range(1, order + 1)])
        history.append(row @ coef)
    return np.array(history[order:])


def factor_ar1_arrays(f: np.ndarray, ddof: int = 0):
    """Least-squares AR(1) of all columns of ``f`` at once: intercept, slope within 0.99, residual deviation of at least
    ``FLOOR``; zeros for columns of fewer than three values. A constant column has slope 0."""
    if len(f) < 3:
        return (np.zeros(f.shape[1]),) * 3
    before, now = f[:-1] - f[:-1].mean(axis=0), f[1:] - f[1:].mean(axis=0)
    spread = (before**2).sum(axis=0)
    slope = np.where(spread > 0, (before * now).sum(axis=0) / np.where(spread > 0, spread, 1.0), 0.0)
    deviation = np.sqrt(((now - slope * before) ** 2).sum(axis=0) / (len(now) - ddof))
    return f[1:].mean(axis=0) - slope * f[:-1].mean(axis=0), np.clip(slope, -0.99, 0.99), np.maximum(deviation, FLOOR)


def _model_row(spec: FactorSpec, key: tuple, n: int, counts: np.ndarray, total: float, values: np.ndarray, vectors: np.ndarray) -> dict:
    """Singular values, scores and factor dynamics of one window from the eigenvalues (largest first) and vectors (rows)
    of its cross-moment matrix."""
    kept = np.flatnonzero(counts > 0)
    m = len(counts)
    k = min(spec.k, min(len(kept), n) - 1) if spec.prepare == "ready" else spec.k
    row = dict.fromkeys(name.split()[0] for name in MODEL.split(", "))
    row |= dict(zip(("panel_id", "origin", "start", "width"), key)) | {"k": max(k, 0), "n_series": n, "n_rows": len(kept)}
    if n < spec.k and spec.prepare == "pca" or k < 1 or len(kept) < max(spec.order + 3, k):
        return row | {"status": "too few series or periods"}
    s = np.sqrt(np.maximum(values[:k], 0.0))
    u = vectors[:k]
    u = u * np.sign(u[np.arange(k), np.abs(u).argmax(axis=1)])[:, None]
    scores = (u * s[:, None])[:, kept].T
    row |= {"total": total, "s": s.tolist(), "u": u.ravel().tolist(), "scores": (u * s[:, None]).ravel().tolist(),
            "f_last": scores[-1].tolist(), "f_prev": scores[-2].tolist(), "status": "ok"}
    if spec.dynamics == "var":
        path = _var_path(scores, spec.order, spec.horizon)
    elif spec.dynamics == "decay":
        path = scores[-1] * spec.persistence ** np.arange(1, spec.horizon + 1)[:, None]
    else:
        c, phi, sigma = factor_ar1_arrays(scores)
        row |= {"c": c.tolist(), "phi": phi.tolist(), "sigma": sigma.tolist()}
        path = np.zeros((spec.horizon, k))
        f = scores[-1]
        for h in range(spec.horizon):
            f = c + phi * f
            path[h] = f
    return row | {"path": path.ravel().tolist()}


def _window_model(spec: FactorSpec):
    """Singular vectors and factor dynamics of one window from its finished cross-moment matrix."""

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        panel, origin, start, width = cells[["panel_id", "origin", "start", "width"]].iloc[0]
        i, j, g = (cells[c].to_numpy() for c in ("i", "j", "g"))
        n = int(g[i == -1].sum())
        m = width - 2 if spec.prepare == "ready" else width
        counts = np.zeros(m)
        at = (j == -1) & (i >= 0)
        counts[i[at]] = g[at]
        gram = np.zeros((m, m))
        at = j >= 0
        gram[i[at], j[at]] = g[at]
        gram = np.triu(gram) + np.triu(gram, 1).T
        values, vectors = np.linalg.eigh(gram[np.ix_(kept := np.flatnonzero(counts > 0), kept)])
        full = np.zeros((len(values), m))
        full[:, kept] = vectors.T[::-1]
        return pd.DataFrame([_model_row(spec, (panel, origin, start, width), n, counts, float(np.trace(gram)), values[::-1], full)])

    return fit


def _prepared_series(spec: FactorSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (panel, n), part in batch.assign(n=batch["v"].map(len)).groupby(["panel_id", "n"]):
                z, seen, _, _, usable, _ = prepared(as_block(part["v"], n), part["tcode"].to_numpy(), _days(part["first_ds"].iloc[0], n, spec.freq), spec)
                yield pd.DataFrame({"panel_id": panel, "series": part["series"].to_numpy(), "usable": usable, "z": list(z), "seen": list(seen)})

    return run


def _whole_model(spec: FactorSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                width = r.m + (2 if spec.prepare == "ready" else 0)
                vectors = np.asarray(r.vectors, dtype=float).reshape(-1, r.m)
                yield pd.DataFrame([_model_row(spec, (r.panel_id, 0, 0, width), int(r.n_series), np.asarray(r.counts, dtype=float), r.total, np.asarray(r.found, dtype=float), vectors)])

    return run


def whole_models(packed: DataFrame, spec: FactorSpec) -> DataFrame:
    """One row per panel with singular values, scores, factor dynamics and factor path over its whole calendar."""
    z = packed.select(*KEYS, "tcode", "first_ds", "v").mapInPandas(_prepared_series(spec), "panel_id string, series string, usable boolean, z array<double>, seen array<boolean>")
    return leading(z, spec.k).mapInPandas(_whole_model(spec), MODEL)


def window_models(packed: DataFrame, spec: FactorSpec) -> DataFrame:
    """One row per panel and window with singular values, scores, factor dynamics and factor path.

    Whole panels may have any number of periods, rolling windows at most ``MAX_WINDOW``.
    """
    if not spec.window:
        return whole_models(packed, spec)
    cells = spread(cross_moments(packed, spec), "panel_id", "origin")
    return cells.groupBy("panel_id", "origin").applyInPandas(_window_model(spec), MODEL)


def _explained(models: DataFrame) -> DataFrame:
    share = F.aggregate("s", F.lit(0.0), lambda a, s: a + s * s) / F.col("total")
    return models.select("panel_id", "origin", "k", "n_series", "n_rows", (share * 100).alias("explained_pct"), "status")


def explained_variance(packed: DataFrame, spec: FactorSpec) -> DataFrame:
    """Share of variance (percent) that the factors carry, per window."""
    return _explained(window_models(packed, spec))


def factor_scores(models: DataFrame) -> DataFrame:
    """Scores as rows ``(origin, t, k, f)``; ``t`` counts from the panel's first period."""
    cut = F.when(F.size("u") == F.col("k") * F.col("width"), F.lit(0)).otherwise(F.lit(2))
    rows = models.filter("status = 'ok'").select("panel_id", "origin", "start", "width", "k", cut.alias("cut"), F.posexplode("scores").alias("pos", "f"))
    m = F.col("width") - F.col("cut")
    return rows.select(
        "panel_id", "origin", (F.col("start") + F.col("cut") + F.col("pos") % m + 1).cast("int").alias("t"),
        (F.floor(F.col("pos") / m) + 1).cast("int").alias("k"), "f",
    )


def _series_models(packed: DataFrame, models: DataFrame) -> DataFrame:
    """Each series' window beside the model of that window; the window is cut before it leaves the JVM."""
    usable = models.select("panel_id", "origin", "start", "width", "k", "n_series", "s", "u", "path", "c", "phi", "sigma", "f_prev", "f_last", "status")
    joined = packed.join(usable, "panel_id")
    return joined.withColumn("v", F.slice("v", F.col("start") + 1, F.col("width")))


def _blocks(batch: pd.DataFrame):
    """Series of one batch that share a window."""
    return batch.groupby(["panel_id", "origin"], sort=False)


def _loadings(z: np.ndarray, head) -> np.ndarray:
    u = np.asarray(head["u"], dtype=float).reshape(int(head["k"]), -1)
    s = np.maximum(np.asarray(head["s"], dtype=float), 1e-12)
    return z @ u.T / s


def _project(spec: FactorSpec, keep_loadings: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (panel, origin), part in _blocks(batch):
                head = part.iloc[0]
                width = int(head["width"])
                v, codes = as_block(part["v"], width), part["tcode"].to_numpy()
                h = spec.horizon
                levels, fx = np.full((len(part), h), np.nan), np.full((len(part), h), np.nan)
                loadings = [None] * len(part)
                if head["status"] == "ok":
                    days = _days(head["first_ds"], int(head["start"]) + width, spec.freq)[int(head["start"]) :]
                    z, _, mu, sd, usable, _ = prepared(v, codes, days, spec)
                    load = _loadings(z, head)
                    path = np.asarray(head["path"], dtype=float).reshape(h, -1)
                    fx = np.where(usable[:, None], load @ path.T * sd[:, None] + mu[:, None], np.nan)
                    levels = level_rows(fx, *last_two(v), codes)
                    loadings = [row.tolist() if ok else None for row, ok in zip(load, usable)]
                out = pd.DataFrame({
                    "panel_id": panel, "series": part["series"].to_numpy(), "origin": int(origin), "t_last": int(head["start"]) + width,
                    "first_ds": head["first_ds"], "fx": list(fx), "levels": list(levels), "status": head["status"],
                })
                if keep_loadings:
                    out["loadings"] = loadings
                yield out

    return run


PROJECTED = "panel_id string, series string, origin int, t_last int, first_ds date, fx array<double>, levels array<double>, status string"


def forecast_panel(packed: DataFrame, spec: FactorSpec, models: DataFrame | None = None) -> DataFrame:
    """Factor forecasts in levels ``(series, origin, h, ds, value)`` for every series and window.

    Series that were not usable keep their rows with a NULL value; ``status`` tells failed windows.
    """
    models = window_models(packed, spec) if models is None else models
    schema = PROJECTED.replace("first_ds date", "first_ds timestamp") if spec.freq == "hour" else PROJECTED
    rows = _series_models(packed, models).mapInPandas(_project(spec, False), schema)
    steps = rows.select(*KEYS, "origin", "t_last", "first_ds", "status", F.posexplode("levels").alias("_i", "value"))
    h = F.col("_i") + 1
    ds = shifted(F.col("first_ds"), F.col("t_last") + F.col("_i"), spec.freq)
    return steps.select(*KEYS, "origin", h.alias("h"), ds.alias("ds"), F.nanvl("value", F.lit(None)).alias("value"), "status")


def panel_loadings(packed: DataFrame, spec: FactorSpec, models: DataFrame) -> DataFrame:
    """Loadings as rows ``(series, origin, k, l)`` of the usable series."""
    rows = _series_models(packed, models).mapInPandas(_project(spec, True), PROJECTED + ", loadings array<double>")
    return rows.filter("loadings is not null").select(*KEYS, "origin", F.posexplode("loadings").alias("_i", "l")).select(
        *KEYS, "origin", (F.col("_i") + 1).alias("k"), "l"
    )


def rolling_forecast(packed: DataFrame, spec: FactorSpec) -> DataFrame:
    """Forecast ``spec.horizon`` steps after every rolling window, keeping the last step; failed windows are left out."""
    steps = forecast_panel(packed, spec)
    return steps.filter((F.col("h") == spec.horizon) & (F.col("status") == "ok")).drop("status")


def horizon_sweep(packed: DataFrame, spec: FactorSpec, horizons: list[int]) -> DataFrame:
    """One fit, forecast to the longest horizon, one table per horizon told apart by ``horizon``."""
    whole = forecast_panel(packed, spec)
    sets = F.filter(F.array(*[F.lit(x) for x in sorted(horizons)]), lambda x: x >= F.col("h"))
    return whole.select("*", F.explode(sets).alias("horizon"))


def manifest(sweep: DataFrame) -> DataFrame:
    """Rows, series and span of every horizon's forecast."""
    return sweep.groupBy("panel_id", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("series").alias("n_series"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds")
    )


# ------------------------------------------------------------- factors given as rows


def window_moments(panel: DataFrame, window: int, horizon: int = 1, x: str = "x") -> DataFrame:
    """Count, mean and deviation of every rolling window of every series, by a frame over the rows in time order."""
    series = Window.partitionBy(*KEYS).orderBy("t")
    frame = series.rowsBetween(0, window - 1)
    rows = panel.select(
        *KEYS, (F.row_number().over(series) - 1).alias("origin"), F.count(x).over(frame).cast("int").alias("n"), F.avg(x).over(frame).alias("mu"),
        F.stddev_samp(x).over(frame).alias("sd"), F.count(F.lit(1)).over(Window.partitionBy(*KEYS)).alias("_periods"),
    )
    return rows.filter(F.col("origin") <= F.col("_periods") - window - horizon).drop("_periods")


def factor_ar1(factors: DataFrame, ddof: int = 0) -> DataFrame:
    """AR(1) of each factor ``(panel_id, k, t, f)``: slope clipped to 0.99, residual deviation at least 0.01."""
    w = Window.partitionBy("panel_id", "k").orderBy("t")
    rows = factors.withColumn("_b", F.lag("f").over(w)).filter("_b is not null")
    n = F.count(F.lit(1))
    rss = F.regr_syy("f", "_b") - F.coalesce(F.try_divide(F.regr_sxy("f", "_b") * F.regr_sxy("f", "_b"), F.regr_sxx("f", "_b")), F.lit(0.0))
    sd = F.sqrt(F.greatest(F.try_divide(rss, n - ddof), F.lit(0.0)))
    return rows.groupBy("panel_id", "k").agg(
        F.regr_intercept("f", "_b").alias("c"),
        F.greatest(F.least(F.regr_slope("f", "_b"), F.lit(0.99)), F.lit(-0.99)).alias("phi"),
        F.greatest(sd, F.lit(FLOOR)).alias("sigma"),
        F.max_by("f", "t").alias("f_last"),
        n.alias("n"),
    ).filter("n >= 2")


def map_factors(factors: DataFrame, loadings: DataFrame, step: str = "h") -> DataFrame:
    """Common component ``sum_k f_k l_k`` per series and step."""
    return (
        loadings.join(factors.select("panel_id", "k", step, "f"), ["panel_id", "k"])
        .groupBy(*KEYS, step)
        .agg(F.sum(F.col("f") * F.col("l")).alias("common"))
    )


def idiosyncratic_sd(z: DataFrame, common: DataFrame, ddof: int = 0) -> DataFrame:
    """Deviation of what the factors leave unexplained, at least 0.01."""
    e = F.col("z") - F.col("common")
    sd = F.stddev_pop(e) if ddof == 0 else F.stddev_samp(e)
    return z.join(common, [*KEYS, "t"]).groupBy(*KEYS).agg(F.greatest(sd, F.lit(FLOOR)).alias("psi"))


# ------------------------------------------------------------- predictive draws

DRAWN = (
    "panel_id string, series string, t int, value double, mean double, p5 double, p95 double, sd double, "
    "usable boolean, draws array<double>"
)


def midpoint_percentile(values: np.ndarray, share: float) -> np.ndarray:
    """Order-statistic percentile with mid-point plotting positions, along the last axis."""
    ordered = np.sort(values, axis=-1)
    n = ordered.shape[-1]
    return np.apply_along_axis(lambda r: np.interp(share * n, np.arange(n) + 0.5, r), -1, ordered)


def _draw_step(spec: FactorSpec, sims: int, seed: int, center: str, keep: bool, midpoint: bool):
    """One period ahead for every series of a batch: simulated levels, their mean and 5%/95% points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths: dict = {}
        for batch in batches:
            for (panel, origin), part in _blocks(batch):
                head = part.iloc[0]
                width = int(head["width"])
                v, codes = as_block(part["v"], width), part["tcode"].to_numpy()
                b = len(part)
                out = {c: np.full(b, np.nan) for c in ("value", "mean", "p5", "p95", "sd")}
                usable, kept = np.zeros(b, bool), [None] * b
                if head["status"] == "ok":
                    days = _days(head["first_ds"], int(head["start"]) + width, spec.freq)[int(head["start"]) :]
                    z, _, mu, sd, usable, _ = prepared(v, codes, days, spec)
                    load = _loadings(z, head)
                    u = np.asarray(head["u"], dtype=float).reshape(int(head["k"]), -1) * np.asarray(head["s"], dtype=float)[:, None]
                    psi = np.maximum((z - load @ u).std(axis=1), FLOOR)
                    key = (panel, int(origin), width)
                    if key not in paths:
                        paths[key] = factor_paths(stream(seed, panel, width, "f"), sims, 1, head)[:, 0, :]
                    noise = np.stack([stream(seed, panel, width, s).standard_normal(sims) for s in part["series"]])
                    std = load @ paths[key].T + psi[:, None] * noise
                    trans = std * sd[:, None] + mu[:, None]
                    last, prev = last_two(v)
                    draws = level_rows(trans[:, :, None], last, prev, codes, repeat=True)[:, :, 0]
                    point = level_rows(trans.mean(axis=1)[:, None], last, prev, codes, repeat=True)[:, 0]
                    draws[~usable] = np.nan
                    out["mean"] = draws.mean(axis=1)
                    out["value"] = np.where(usable, point if center == "point" else out["mean"], np.nan)
                    ends = [midpoint_percentile(draws, p) for p in (0.05, 0.95)] if midpoint else np.percentile(draws, [5, 95], axis=1)
                    out["p5"], out["p95"] = ends
                    out["sd"] = draws.std(axis=1)
                    if keep:
                        kept = [row.tolist() if ok else None for row, ok in zip(draws, usable)]
                yield pd.DataFrame({
                    "panel_id": panel, "series": part["series"].to_numpy(), "t": int(head["start"]) + width + 1, **out, "usable": usable, "draws": kept,
                })[["panel_id", "series", "t", "value", "mean", "p5", "p95", "sd", "usable", "draws"]]

    return run


def draw_next(
    packed: DataFrame, spec: FactorSpec, sims: int = 1000, seed: int = 0, center: str = "draws", keep: bool = False, midpoint: bool = False,
) -> DataFrame:
    """Simulated next period of every series from the efficient factor model.

    ``value`` is the mean of the simulated levels (``center='draws'``) or the level of the mean (``'point'``).
    ``midpoint`` takes mid-point percentiles; ``keep`` returns the simulated levels too.
    Random streams are named by panel, series and period, so results do not depend on partitioning.
    """
    rows = _series_models(packed, window_models(packed, spec))
    return rows.mapInPandas(_draw_step(spec, sims, seed, center, keep, midpoint), DRAWN)
