"""Dynamic factor models fitted by iteration: expectation-maximisation and Gibbs sampling.

Both run in one of two ways with the same numeric steps. A panel of at most ``max_cells`` cells is fitted whole
inside a task, so a fleet of ordinary panels (and their chains) runs as independent tasks. A larger panel is
never gathered: every iteration sums the series' information where they are, makes one small step per panel on
the sum, and updates the series in place; each iteration ends in a checkpoint. Random streams are named by panel,
chain, iteration and series, so both ways draw the same values, up to the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import statespace as S
from tidepanel.functions.dates import shifted
from tidepanel.functions.panelmath import as_block, last_two, level_rows, stream
from tidepanel.operators import factor
from tidepanel.operators.inverse import level_path
from tidepanel.panel import KEYS
from tidepanel.session import cut_lineage, spread

MAX_CELLS = 2_000_000  # panel cells that one task may hold (16 MB of doubles)
DRAWS_PER_TABLE = 25  # draws of the distributed sampler that are stored together

ROW = "panel_id string, series string, tcode int, first_ds timestamp, n_levels int, z array<double>, mu double, sd double, last double, prev double"
STATE = ROW + ", chain int, lam array<double>, psi double, theta array<double>"
DRAWS = "panel_id string, chain int, draw int, param string, series string, i int, k int, value double"
SUMS = "panel_id string, chain int, size int, k int, idx int, val double"
STEP = "panel_id string, chain int, f array<double>, p array<double>, theta array<double>"


# ------------------------------------------------------------- standardised series


def _standardize(spec: factor.FactorSpec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (panel, n), part in batch.assign(n=batch["v"].map(len)).groupby(["panel_id", "n"]):
                v, codes = as_block(part["v"], n), part["tcode"].to_numpy()
                z, seen, mu, sd, usable, _ = factor.prepared(v, codes, factor._days(part["first_ds"].iloc[0], n, spec.freq), spec)
                z = np.where(seen, z, np.nan)
                last, prev = last_two(v)
                out = part[["panel_id", "series", "tcode", "first_ds"]].assign(n_levels=n, z=list(z), mu=mu, sd=sd, last=last, prev=prev)
                yield out[usable]

    return run


def standardized(packed: DataFrame, spec: factor.FactorSpec) -> DataFrame:
    """The usable series of a panel, standardised, one row each; missing cells are NULL."""
    return packed.withColumn("first_ds", F.col("first_ds").cast("timestamp")).mapInPandas(_standardize(spec), ROW)


def split_by_size(packed: DataFrame, max_cells: int) -> tuple[DataFrame, DataFrame | None]:
    """(panels that fit into a task, larger panels or None). Counts the cells per panel once."""
    sizes = packed.groupBy("panel_id").agg(F.sum(F.size("v").cast("long")).alias("_cells"))
    large = sizes.filter(F.col("_cells") > max_cells).select("panel_id")
    if large.limit(1).count() == 0:
        return packed, None
    return packed.join(large, "panel_id", "left_anti"), packed.join(large, "panel_id", "left_semi")


# ------------------------------------------------------------- one iteration, distributed


def _partial_information(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Information sums of the task's series. Negative indices carry the panel's dynamics along."""
    held: dict = {}
    for batch in batches:
        for (panel, chain), part in batch.groupby(["panel_id", "chain"]):
            z, lam = as_block(part["z"]), as_block(part["lam"])
            info = S.information(z, lam, part["psi"].to_numpy())
            key = (panel, int(chain), z.shape[1], lam.shape[1])
            total, _ = held.get(key, (0.0, None))
            held[key] = (total + info.ravel(), np.asarray(part["theta"].iloc[0], dtype=float))
    for (panel, chain, size, k), (total, theta) in held.items():
        yield pd.DataFrame({
            "panel_id": panel, "chain": chain, "size": size, "k": k,
            "idx": np.concatenate([np.arange(len(total)), -1 - np.arange(len(theta))]), "val": np.concatenate([total, theta]),
        })


def _information(state: DataFrame) -> DataFrame:
    parts = state.select("panel_id", "chain", "z", "lam", "psi", "theta").mapInPandas(_partial_information, SUMS)
    total = F.when(F.col("idx") < 0, F.max("val")).otherwise(F.sum("val"))
    return parts.groupBy("panel_id", "chain", "size", "k", "idx").agg(total.alias("val"))


def _read_sums(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    size, k = int(cells["size"].iloc[0]), int(cells["k"].iloc[0])
    ordered = cells.sort_values("idx")
    values, idx = ordered["val"].to_numpy(), ordered["idx"].to_numpy()
    return values[idx >= 0].reshape(size, k, k + 1), values[idx < 0][::-1]


def _dynamics(theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (K, K p) and noise (K, K) from the flat vector."""
    return theta[: -k * k].reshape(k, -1), theta[-k * k :].reshape(k, k)


def _em_step(cells: pd.DataFrame) -> pd.DataFrame:
    info, theta = _read_sums(cells)
    k = info.shape[1]
    ms, ps, lag = S.smooth(info, *_dynamics(theta, k))
    coef, noise = S.em_dynamics(ms, ps, lag, k)
    head = cells[["panel_id", "chain"]].iloc[0].to_dict()
    return pd.DataFrame([head | {
        "f": ms[:, :k].ravel().tolist(), "p": ps[:, :k, :k].ravel().tolist(), "theta": np.concatenate([coef.ravel(), noise.ravel()]).tolist(),
    }])


def _gibbs_step(seed: int, iteration: int):
    def step(cells: pd.DataFrame) -> pd.DataFrame:
        info, theta = _read_sums(cells)
        panel, chain = cells["panel_id"].iloc[0], int(cells["chain"].iloc[0])
        f, phi, sigma2 = _gibbs_factors(info, theta, stream(seed, panel, chain, iteration))
        return pd.DataFrame([{"panel_id": panel, "chain": chain, "f": f.ravel().tolist(), "p": [], "theta": np.concatenate([phi, sigma2]).tolist()}])

    return step


def _gibbs_factors(info: np.ndarray, theta: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = info.shape[1]
    f = S.sample_factors(info, theta[:k], theta[k:], rng)
    return f, *S.sample_dynamics(f, theta[k:], rng)


def _row_noise(seed: int, panel: str, chain: int, iteration: int, series, k: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal and gamma draws of every series from its own stream."""
    normals, gammas = np.zeros((len(series), k)), np.zeros(len(series))
    for i, name in enumerate(series):
        rng = stream(seed, panel, chain, iteration, name)
        normals[i], gammas[i] = rng.standard_normal(k), rng.gamma(3.0 + periods / 2)
    return normals, gammas


def _update_rows(kind: str, seed: int, iteration: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (panel, chain), part in batch.groupby(["panel_id", "chain"]):
                z = as_block(part["z"])
                f = np.asarray(part["f"].iloc[0], dtype=float).reshape(z.shape[1], -1)
                t, k = f.shape
                if kind == "em":
                    p = np.asarray(part["p"].iloc[0], dtype=float)
                    lam, psi = S.em_rows(z, f, p.reshape(t, k, k) if len(p) else np.zeros((t, k, k)))
                else:
                    lam, psi = S.sample_rows(z, part["psi"].to_numpy(), f, *_row_noise(seed, panel, chain, iteration, part["series"], k, t))
                yield part.assign(lam=list(lam), psi=psi)[[c.split()[0] for c in STATE.split(", ")]]

    return run


def _advance(state: DataFrame, step: DataFrame, kind: str, seed: int = 0, iteration: int = 0) -> DataFrame:
    joined = state.drop("theta").join(step, ["panel_id", "chain"])
    return joined.mapInPandas(_update_rows(kind, seed, iteration), STATE)


# ------------------------------------------------------------- starting values


def _start(rows: DataFrame, models: DataFrame, kind: str, order: int, chains: int) -> DataFrame:
    """Loadings, variances and dynamics from the principal components of the panel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (panel, chain), part in batch.groupby(["panel_id", "chain"]):
                head = part.iloc[0]
                z = as_block(part["z"])
                k = int(head["k"])
                if kind == "em":
                    f = np.asarray(head["scores"], dtype=float).reshape(k, -1).T
                    lam, psi = S.em_rows(z, f, np.zeros((len(f), k, k)))
                    rows_ = np.column_stack([f[order - i : len(f) - i] for i in range(1, order + 1)])
                    coef = np.linalg.lstsq(rows_, f[order:], rcond=None)[0].T
                    theta = np.concatenate([coef.ravel(), (np.cov((f[order:] - rows_ @ coef.T).T).reshape(k, k) + np.eye(k) * 1e-4).ravel()])
                else:
                    lam = factor._loadings(np.nan_to_num(z), head)
                    psi, theta = np.full(len(part), 0.5), np.concatenate([np.zeros(k), np.ones(k)])
                yield part.assign(lam=list(lam), psi=psi, theta=[theta] * len(part))[[c.split()[0] for c in STATE.split(", ")]]

    fitted = models.filter("status = 'ok'").select("panel_id", "k", "s", "u", "scores")
    chained = rows.join(fitted, "panel_id").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return chained.mapInPandas(run, STATE)


def _started(packed: DataFrame, spec: factor.FactorSpec, kind: str, chains: int = 1) -> DataFrame:
    return _start(standardized(packed, spec), factor.window_models(packed, spec), kind, spec.order, chains)


# ------------------------------------------------------------- expectation-maximisation


def _em_in_task(iterations: int):
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        z, lam, psi = as_block(part["z"]), as_block(part["lam"]), part["psi"].to_numpy()
        k = lam.shape[1]
        theta = np.asarray(part["theta"].iloc[0], dtype=float)
        for _ in range(iterations):
            ms, ps, lag = S.smooth(S.information(z, lam, psi), *_dynamics(theta, k))
            coef, noise = S.em_dynamics(ms, ps, lag, k)
            theta = np.concatenate([coef.ravel(), noise.ravel()])
            lam, psi = S.em_rows(z, ms[:, :k], ps[:, :k, :k])
        return part.assign(lam=list(lam), psi=psi, theta=[theta] * len(part))

    return fit


def _em_path(horizon: int):
    """Factor path after the last period under the fitted dynamics."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        info, theta = _read_sums(cells)
        k = info.shape[1]
        coef, noise = _dynamics(theta, k)
        state = S.smooth(info, coef, noise)[0][-1]
        trans, _ = S.companion(coef, noise, k)
        path = np.zeros((horizon, k))
        for h in range(horizon):
            state = trans @ state
            path[h] = state[:k]
        head = cells[["panel_id", "chain"]].iloc[0].to_dict()
        return pd.DataFrame([head | {"path": path.ravel().tolist()}])

    return run


def fit_dfm(packed: DataFrame, spec: factor.FactorSpec, iterations: int = 50, max_cells: int = MAX_CELLS) -> DataFrame:
    """State-space dynamic factor model by EM; returns the fitted state, one row per series, checkpointed.

    Factors follow a VAR of ``spec.order``; errors are independent over series and time.
    """
    if spec.prepare != "pca":
        raise ValueError("the state-space model keeps missing cells: use prepare='pca'")
    packed = cut_lineage(packed)
    small, large = split_by_size(packed, max_cells)
    start = spread(_started(small, spec, "em"), "panel_id", "chain")
    fitted = cut_lineage(start.groupBy("panel_id", "chain").applyInPandas(_em_in_task(iterations), STATE))
    if large is None:
        return fitted
    state = cut_lineage(_started(large, spec, "em"))
    for it in range(iterations):
        step = _information(state).groupBy("panel_id", "chain").applyInPandas(_em_step, STEP)
        state = cut_lineage(_advance(state, step, "em", 0, it))
    return fitted.unionByName(state)


def period_after(first: Column, periods: Column, freq: str) -> Column:
    """The period that many after the first one: a date, or for hours a time."""
    return shifted(first if freq == "hour" else first.cast("date"), periods, freq)


def dfm_forecast(packed: DataFrame, spec: factor.FactorSpec, iterations: int = 50, max_cells: int = MAX_CELLS) -> DataFrame:
    """Level forecasts ``(series, h, ds, value)`` of the state-space model."""
    state = fit_dfm(packed, spec, iterations, max_cells)
    paths = _information(state).groupBy("panel_id", "chain").applyInPandas(_em_path(spec.horizon), "panel_id string, chain int, path array<double>")
    k = F.size("lam")
    fx = F.transform(
        F.sequence(F.lit(0), F.lit(spec.horizon - 1)),
        lambda h: F.aggregate(F.zip_with(F.slice("path", h * k + 1, k), F.col("lam"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) * F.col("sd") + F.col("mu"),
    )
    rows = state.join(paths, ["panel_id", "chain"])
    last, prev = (F.nanvl(c, F.lit(None)) for c in ("last", "prev"))
    levels = rows.select(*KEYS, "first_ds", "n_levels", F.posexplode(level_path(fx, last, prev, F.col("tcode"))).alias("_i", "value"))
    ds = period_after(F.col("first_ds"), F.col("n_levels") + F.col("_i"), spec.freq)
    return levels.select(*KEYS, (F.col("_i") + 1).alias("h"), ds.alias("ds"), "value")


# ------------------------------------------------------------- Gibbs sampling


def _draw_rows(panel: str, chain: int, draw: int, names, lam, psi, f, phi, sigma2) -> pd.DataFrame:
    """One posterior draw in long form; ``i`` is the period of a factor value."""
    n, k = lam.shape
    t = len(f)
    series = np.asarray(names, dtype=object)
    blocks = [
        ("Lambda", np.repeat(series, k), np.full(n * k, -1), np.tile(np.arange(k), n), lam.ravel()),
        ("Psi", series, np.full(n, -1), np.full(n, -1), psi),
        ("F", np.full(t * k, None), np.repeat(np.arange(t), k), np.tile(np.arange(k), t), f.ravel()),
        ("Phi", np.full(k, None), np.full(k, -1), np.arange(k), phi),
        ("Sigma2", np.full(k, None), np.full(k, -1), np.arange(k), sigma2),
    ]
    parts = [pd.DataFrame({"param": p, "series": s, "i": i, "k": kk, "value": v}) for p, s, i, kk, v in blocks if len(v)]
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "draw", draw)
    out.insert(0, "chain", chain)
    out.insert(0, "panel_id", panel)
    return out


def _gibbs_in_task(n_samples: int, n_tune: int, seed: int):
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("series")
        panel, chain = part["panel_id"].iloc[0], int(part["chain"].iloc[0])
        z, lam, psi = as_block(part["z"]), as_block(part["lam"]), part["psi"].to_numpy()
        theta = np.asarray(part["theta"].iloc[0], dtype=float)
        t, k = z.shape[1], lam.shape[1]
        out = []
        for it in range(n_tune + n_samples):
            f, phi, sigma2 = _gibbs_factors(S.information(z, lam, psi), theta, stream(seed, panel, chain, it))
            theta = np.concatenate([phi, sigma2])
            lam, psi = S.sample_rows(z, psi, f, *_row_noise(seed, panel, chain, it, part["series"], k, t))
            if it >= n_tune:
                out.append(_draw_rows(panel, chain, it - n_tune, part["series"], lam, psi, f, phi, sigma2))
        return pd.concat(out, ignore_index=True)

    return fit


def _large_draws(state: DataFrame, step: DataFrame, draw: int) -> DataFrame:
    """Long draw rows of one iteration of the distributed sampler."""
    k = F.size("lam")
    none, no = F.lit(None).cast("string"), F.lit(-1)
    lam = state.select("panel_id", "chain", F.lit("Lambda").alias("param"), "series", no.alias("i"), F.posexplode("lam").alias("k", "value"))
    psi = state.select("panel_id", "chain", F.lit("Psi").alias("param"), "series", no.alias("i"), no.alias("k"), F.col("psi").alias("value"))
    half = (F.size("theta") / 2).cast("int")
    factors = step.select("panel_id", "chain", half.alias("_k"), F.posexplode("f").alias("_p", "value")).select(
        "panel_id", "chain", F.lit("F").alias("param"), none.alias("series"),
        F.floor(F.col("_p") / F.col("_k")).cast("int").alias("i"), (F.col("_p") % F.col("_k")).alias("k"), "value",
    )
    theta = step.select("panel_id", "chain", half.alias("_k"), F.posexplode("theta").alias("_p", "value")).select(
        "panel_id", "chain", F.when(F.col("_p") < F.col("_k"), F.lit("Phi")).otherwise(F.lit("Sigma2")).alias("param"), none.alias("series"),
        no.alias("i"), (F.col("_p") % F.col("_k")).alias("k"), "value",
    )
    rows = reduce(DataFrame.unionByName, [lam, psi, factors, theta]).withColumn("draw", F.lit(draw))
    return rows.select("panel_id", "chain", "draw", "param", "series", "i", "k", "value")


def gibbs(
    packed: DataFrame, spec: factor.FactorSpec, n_samples: int = 1000, n_tune: int = 500, chains: int = 1, seed: int = 0, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Posterior draws ``(panel_id, chain, draw, param, series, i, k, value)`` of the Bayesian factor model, checkpointed.

    Factors are AR(1) and drawn by forward filtering and backward sampling; loadings have a standard normal prior,
    series variances an inverse gamma (3, 2), innovation variances an inverse gamma (3, 1).
    """
    packed = cut_lineage(packed)
    small, large = split_by_size(packed, max_cells)
    start = spread(_started(small, spec, "gibbs", chains), "panel_id", "chain")
    draws = cut_lineage(start.groupBy("panel_id", "chain").applyInPandas(_gibbs_in_task(n_samples, n_tune, seed), DRAWS))
    if large is None:
        return draws
    state, kept, stored = cut_lineage(_started(large, spec, "gibbs", chains)), [], [draws]
    for it in range(n_tune + n_samples):
        step = cut_lineage(_information(state).groupBy("panel_id", "chain").applyInPandas(_gibbs_step(seed, it), STEP))
        state = cut_lineage(_advance(state, step, "gibbs", seed, it))
        if it >= n_tune:
            kept.append(_large_draws(state, step, it - n_tune))
        if len(kept) == DRAWS_PER_TABLE or it == n_tune + n_samples - 1:
            stored.append(cut_lineage(reduce(DataFrame.unionByName, kept)))
            kept = []
    return reduce(DataFrame.unionByName, stored)


def posterior_means(draws: DataFrame) -> DataFrame:
    """Mean of every parameter over chains and draws."""
    return draws.groupBy("panel_id", "param", "series", "i", "k").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_draws"))


def posterior_factors(draws: DataFrame) -> DataFrame:
    """Posterior mean factors as rows ``(panel_id, k, t, f)``."""
    means = posterior_means(draws.filter("param = 'F'"))
    return means.select("panel_id", (F.col("k") + 1).alias("k"), (F.col("i") + 1).alias("t"), F.col("value").alias("f"))


def _ar1_draws(n_samples: int, n_tune: int, seed: int):
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        panel, k = part["panel_id"].iloc[0], int(part["k"].iloc[0])
        out = S.sample_ar1(part["f"].to_numpy(), n_samples, n_tune, stream(seed, panel, "ar", k))
        return pd.DataFrame({"panel_id": panel, "k": k, "draw": np.arange(n_samples), "c": out[:, 0], "phi": out[:, 1], "sigma": out[:, 2], "f_last": part["f"].iloc[-1]})

    return fit


AR_DRAWS = "panel_id string, k int, draw int, c double, phi double, sigma double, f_last double"


def factor_ar1_draws(factors: DataFrame, n_samples: int = 500, n_tune: int = 250, seed: int = 0) -> DataFrame:
    """Bayesian AR(1) of every factor: one small task per panel and factor."""
    return factors.groupBy("panel_id", "k").applyInPandas(_ar1_draws(n_samples, n_tune, seed), AR_DRAWS)


# ------------------------------------------------------------- posterior prediction


def _panel_paths(sims: int, horizon: int, seed: int, step: int):
    """Factor values of every simulation from AR draws (one row per factor, arrays over draws)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        panel = part["panel_id"].iloc[0]
        rng = stream(seed, panel, "path", step)
        out = np.zeros((sims, horizon, len(part)))
        for j, row in enumerate(part.itertuples()):
            c, phi, sigma = (np.asarray(getattr(row, n), dtype=float) for n in ("c", "phi", "sigma"))
            f = np.full(sims, float(row.f_last))
            for h in range(horizon):
                pick = rng.integers(len(c), size=sims)
                f = c[pick] + phi[pick] * f + sigma[pick] * rng.standard_normal(sims)
                out[:, h, j] = f
        return pd.DataFrame({"panel_id": [panel], "paths": [out.ravel().tolist()]})

    return run


def _predict_rows(sims: int, horizon: int, seed: int, step: int, keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for panel, part in batch.groupby("panel_id"):
                paths = np.asarray(part["paths"].iloc[0], dtype=float).reshape(sims, horizon, -1)
                k = paths.shape[2]
                rows = []
                for row in part.itertuples():
                    lam, psi = np.asarray(row.lam_draws, dtype=float).reshape(-1, k), np.asarray(row.psi_draws, dtype=float)
                    pick = stream(seed, panel, "pick", step).integers(len(psi), size=sims)
                    rng = stream(seed, panel, row.series, step)
                    shock = rng.standard_normal((sims, horizon))
                    std = np.einsum("sk,shk->sh", lam[pick], paths) + np.sqrt(psi[pick])[:, None] * shock
                    level = level_rows((std * row.sd + row.mu)[None], np.array([row.last]), np.array([row.prev]), np.array([row.tcode]), True)[0]
                    p5, p95 = np.percentile(level, [5, 95], axis=0)
                    for h in range(horizon):
                        rows.append((panel, row.series, int(row.n_levels) + h + 1, level[:, h].mean(), level[:, h].mean(), p5[h], p95[h], level[:, h].std(), True, level[:, h].tolist() if keep else None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in factor.DRAWN.split(", ")])

    return run


def predict(
    packed: DataFrame, spec: factor.FactorSpec, draws: DataFrame, method: str = "bayesian", horizon: int = 1, sims: int = 1000, seed: int = 0,
    step: int = 0, keep: bool = False,
) -> DataFrame:
    """Posterior predictive mean, 5% and 95% points of every series' next periods.

    Each simulation takes one joint draw of loadings and variances. ``bayesian`` runs the mean factors on with the
    least-squares AR(1) of each, ``bayesian-ar`` with a fresh draw of a Bayesian AR(1) at every step.
    """
    per_series = draws.filter("param in ('Lambda', 'Psi')")
    ordered = F.array_sort(F.collect_list(F.struct("chain", "draw", "k", "value")))
    per_series = per_series.groupBy(*KEYS).pivot("param", ["Lambda", "Psi"]).agg(ordered)
    per_series = per_series.select(
        *KEYS, F.transform("Lambda", lambda r: r["value"]).alias("lam_draws"), F.transform("Psi", lambda r: r["value"]).alias("psi_draws")
    )
    paths = _ar_paths(draws, method, sims, horizon, seed, step)
    rows = standardized(packed, spec).drop("z").join(per_series, KEYS).join(paths, "panel_id")
    return rows.mapInPandas(_predict_rows(sims, horizon, seed, step, keep), factor.DRAWN)


PATHS = "panel_id string, paths array<double>"


def _ar_paths(draws: DataFrame, method: str, sims: int, horizon: int, seed: int, step: int) -> DataFrame:
    factors = posterior_factors(draws)
    if method == "bayesian":
        ar = factor.factor_ar1(factors).select("panel_id", "k", "f_last", *[F.array(c).alias(c) for c in ("c", "phi", "sigma")])
    elif method == "bayesian-ar":
        def in_order(c: str):
            return F.transform(F.array_sort(F.collect_list(F.struct("draw", c))), lambda r: r[c]).alias(c)

        ar = factor_ar1_draws(factors, seed=seed).groupBy("panel_id", "k").agg(F.max("f_last").alias("f_last"), *[in_order(c) for c in ("c", "phi", "sigma")])
    else:
        raise ValueError(f"unknown method {method!r}")
    return ar.groupBy("panel_id").applyInPandas(_panel_paths(sims, horizon, seed, step), PATHS)


# ------------------------------------------------------------- methods by name, rolling and filling

METHODS = ("efficient", "bayesian", "bayesian-ar")


def next_period(
    packed: DataFrame, spec: factor.FactorSpec, method: str = "efficient", sims: int = 1000, n_samples: int = 1000, n_tune: int = 500, seed: int = 0,
    center: str = "draws", keep: bool = False, midpoint: bool = False, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Refit on the packed levels and simulate the next period with the named method."""
    if method == "efficient":
        return factor.draw_next(packed, spec, sims, seed, center, keep, midpoint)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    draws = gibbs(packed, spec, n_samples, n_tune, seed=seed, max_cells=max_cells)
    return predict(packed, spec, draws, method, 1, sims, seed, keep=keep)


STEP_ROWS = "panel_id string, series string, mean double, p5 double, p95 double, draws array<double>, status string"


def _stored(spark, path: str) -> bool:
    """Whether a step was written whole; any file system that Spark reaches."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def rolling_horizon(packed: DataFrame, spec: factor.FactorSpec, horizon: int, run_dir: str | None = None, **options) -> DataFrame:
    """Forecast period by period: each step is fitted on the data and the means of the steps before it.

    Returns ``(series, h, ds, mean, p5, p95, draws, status)`` for every series. Steps depend on each other, so they run
    one after the other. A step whose job fails gives rows of NULL with the reason as ``status``, its period stays empty,
    and the next step goes on; in other steps ``status`` is ``ok``, or ``not usable`` for a series without a forecast.

    With ``run_dir``, a folder that all executors reach, each step is a table in it. A run over the same folder takes
    the stored steps as they are and goes on behind the last of them, so the folder must belong to one panel, spec and
    set of options; failed steps are stored too. Without it, steps are checkpointed.
    """
    spark = packed.sparkSession
    if options.get("method", "efficient") not in METHODS:
        raise ValueError(f"unknown method {options['method']!r}")
    history = cut_lineage(packed)
    steps = []
    for h in range(1, horizon + 1):
        path = f"{run_dir.rstrip('/')}/step={h}" if run_dir else None
        if path and _stored(spark, path):
            step = spark.read.schema(STEP_ROWS).parquet(path)
        else:
            step = _outcome(history, spec, path, options)
        grown = cut_lineage(history.join(step, KEYS, "left").withColumn("v", F.concat("v", F.array("mean"))))
        ds = period_after(F.col("first_ds"), F.size("v") - 1, spec.freq)
        steps.append(grown.select(*KEYS, F.lit(h).alias("h"), ds.alias("ds"), "mean", "p5", "p95", "draws", "status"))
        history = grown.select(*packed.columns)
    return reduce(DataFrame.unionByName, steps)


def _outcome(history: DataFrame, spec: factor.FactorSpec, path: str | None, options: dict) -> DataFrame:
    """Rows of one step, stored; of a failed one, NULL rows with the reason."""

    def keep(rows: DataFrame) -> DataFrame:
        if not path:
            return cut_lineage(rows)
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(STEP_ROWS).parquet(path)

    names = history.select(*KEYS)
    empty = [F.lit(None).cast("double").alias(c) for c in ("mean", "p5", "p95")]
    try:
        step = next_period(history, spec, **options)
        values = [F.nanvl(c, F.lit(None)).alias(c) for c in ("mean", "p5", "p95")]
        rows = names.join(step.select(*KEYS, *values, "draws"), KEYS, "left")
        return keep(rows.withColumn("status", F.when(F.col("mean").isNull(), "not usable").otherwise("ok")))
    except PySparkException as exc:
        reason = str(exc).strip().splitlines()[0][:300]
        return keep(names.select(*KEYS, *empty, F.lit(None).cast("array<double>").alias("draws"), F.lit(f"failed: {reason}").alias("status")))


def packed_gaps(packed: DataFrame, kinds: tuple[str, ...] = ("interior", "trailing")) -> DataFrame:
    """Attach ``gaps``: the missing periods of each series after its first observation, by kind."""
    periods = F.sequence(F.lit(1), F.size("v"))
    seen = F.filter(periods, lambda t: F.element_at("v", t).isNotNull())
    first, last = F.try_element_at(seen, F.lit(1)), F.try_element_at(seen, F.lit(-1))

    def wanted(t):
        missing = F.element_at("v", t).isNull() & (t > F.col("_first"))
        kind = F.when(t < F.col("_last"), F.lit("interior")).otherwise(F.lit("trailing"))
        return missing & kind.isin(*kinds)

    spans = packed.withColumns({"_first": first, "_last": last})
    return spans.withColumn("gaps", F.filter(periods, wanted)).drop("_first", "_last")


def fill_gaps(
    packed: DataFrame, spec: factor.FactorSpec, kinds: tuple[str, ...] = ("interior", "trailing"), sims: int = 300, skip_first: int = 3,
    min_rows: int = 10, **options,
) -> DataFrame:
    """Fill missing cells of the given kinds in time order, each period from a model of the periods before it.

    One fit serves every cell of a period. Periods with fewer than ``min_rows`` usable rows before them, or among
    the first ``skip_first``, are left as they are, and no observed cell changes. Returns the packed panel with
    ``filled``, the periods filled. Only the list of incomplete periods, at most a calendar, comes to the driver.
    """
    options.setdefault("center", "point")
    state = cut_lineage(packed_gaps(packed, kinds).withColumn("filled", F.array().cast("array<int>")))
    periods = [r.t for r in state.select(F.explode("gaps").alias("t")).distinct().orderBy("t").collect()]
    for t in periods:
        if t <= skip_first or t - 1 - 2 < min_rows:
            continue
        past = state.select(*[F.slice("v", 1, t - 1).alias("v") if c == "v" else F.col(c) for c in packed.columns])
        step = next_period(past, spec, sims=sims, **options).select(*KEYS, F.nanvl("value", F.lit(None)).alias("_new"))
        here = F.array_contains("gaps", t) & F.col("_new").isNotNull()
        filled = F.concat(F.slice("v", 1, t - 1), F.array(F.col("_new")), F.slice("v", t + 1, F.size("v")))
        state = state.join(step, KEYS, "left").withColumns({
            "v": F.when(here, filled).otherwise(F.col("v")),
            "filled": F.when(here, F.concat("filled", F.array(F.lit(t).cast("int")))).otherwise(F.col("filled")),
        })
        state = cut_lineage(state.drop("_new"))
    return state.drop("gaps")


def unpack_levels(packed: DataFrame, *keep: str, freq: str = "month") -> DataFrame:
    """Packed levels back to long rows ``(series, t, ds, value)``, dated by ``freq``, with any further columns named."""
    rows = packed.select(*KEYS, "first_ds", *keep, F.posexplode("v").alias("_i", "value"))
    return rows.select(*KEYS, (F.col("_i") + 1).alias("t"), period_after(F.col("first_ds"), F.col("_i"), freq).alias("ds"), "value", *keep)
