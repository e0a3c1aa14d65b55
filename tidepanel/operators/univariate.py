"""One model per series: correlograms, order rules, AR, MA and ARIMA fleets, naive forecasts.

Everything is made of Spark expressions: lags by window, sums of products per series, and recursions over the few
coefficients of a series on small arrays (see ``arma``). Nothing is ever gathered across series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import future
from tidepanel.functions.normal import bound, dot
from tidepanel.operators import arma
from tidepanel.operators.inverse import anchor_aggregates, level_path, to_levels, with_previous_level
from tidepanel.operators.transform import stationary
from tidepanel.panel import KEYS, by_time
from tidepanel.session import cut_lineage, spread

#: Values of the series that a task of a fleet fits.
CELLS = 200_000

MIN_OBS = {"ar": 20, "ma": 20, "arima": 30}


def autocorrelation(panel: DataFrame, x: str = "x", max_lag: int = 12) -> DataFrame:
    """Autocorrelations of the observed values, lag 1 to ``max_lag``, as rows ``(lag, r)`` with the count ``n``.

    One window pass and one aggregate per series: no row is paired with another by a join.
    """
    w = by_time()
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = panel.filter(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(whole))
    ahead = seen.withColumns({f"_d{k}": F.lead("_d", k).over(w) for k in range(1, max_lag + 1)})
    sums = ahead.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        *[F.sum(F.col("_d") * F.col(f"_d{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)],
    )
    lags = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_ss")).alias("r")) for k in range(1, max_lag + 1)
    ])
    return sums.select(*KEYS, "n", F.inline(lags))


def _partials(rho: Column) -> Column:
    """Durbin-Levinson recursion on autocorrelations of lag 1, 2, ...: the last coefficient of every step."""
    none = F.array().cast("array<double>")

    def step(held: Column, k: Column) -> Column:
        phi, r = held["phi"], F.get(rho, k)
        below = 1 - dot(phi, rho)
        above = r - dot(phi, F.reverse(F.slice(rho, 1, k)))
        new = lambda a: F.struct(F.array_append(F.zip_with(phi, F.reverse(phi), lambda x, y: x - a * y), a).alias("phi"), F.array_append(held["out"], a).alias("out"))
        return bound(F.try_divide(above, below), new)

    whole = F.aggregate(F.sequence(F.lit(0), F.size(rho) - 1), F.struct(none.alias("phi"), none.alias("out")), step, lambda held: held["out"])
    return F.when(F.size(rho) > 0, whole)


def partial_autocorrelations(acf: DataFrame) -> DataFrame:
    """Partial autocorrelations from ``autocorrelation`` rows (Yule-Walker recursion)."""
    pair = F.struct("lag", "r")
    packed = acf.groupBy(*KEYS, "n").agg(F.array_sort(F.collect_list(pair)).alias("_pairs")).withColumn("_r", F.transform("_pairs", lambda p: p["r"]))
    rows = packed.select(*KEYS, "n", F.posexplode(_partials(F.col("_r"))).alias("_i", "r"))
    return rows.select(*KEYS, "n", (F.col("_i") + 1).alias("lag"), "r")


def choose_order(correlogram: DataFrame, max_lag: int = 12) -> DataFrame:
    """One less than the first lag inside the 95% band, at least 1; ``max_lag`` if none is; 1 for short series."""
    inside = F.abs("r") < F.try_divide(F.lit(1.96), F.sqrt("n"))
    first = F.min(F.when(inside, F.col("lag")))
    order = F.when(F.col("n") < max_lag + 10, F.lit(1)).otherwise(
        F.coalesce(F.greatest(F.col("_first") - 1, F.lit(1)), F.lit(max_lag))
    )
    return correlogram.groupBy(*KEYS, "n").agg(first.alias("_first")).select(*KEYS, "n", order.cast("int").alias("order"))


def ar1_fit(panel: DataFrame, x: str = "x", value: str = "value", min_obs: int = MIN_OBS["ar"]) -> DataFrame:
    """Regress each observed value on the one before it; keep what a forecast needs (anchors, code, last date).

    Built-in regression aggregates over one window pass; everything stays with the series, nothing is joined.
    """
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    rows = with_previous_level(panel, value).withColumn("_before", F.last(x, ignorenulls=True).over(before))
    fit = rows.groupBy(*KEYS).agg(
        F.count(x).alias("n"),
        F.regr_intercept(x, "_before").alias("c"),
        F.regr_slope(x, "_before").alias("phi"),
        F.max_by(x, F.when(F.col(x).isNotNull(), F.col("t"))).alias("x_last"),
        *anchor_aggregates(value),
        F.max("tcode").alias("tcode"),
        F.max("ds").alias("last_ds"),
    )
    return fit.withColumns({c: F.when(F.col("n") >= min_obs, F.col(c)) for c in ("c", "phi")})


def ar1_path(fit: DataFrame, horizon: int) -> DataFrame:
    """AR(1) forecasts for steps 1..horizon in closed form."""
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    power = F.pow("phi", F.col("h"))
    drift = F.when(F.col("phi") == 1, F.col("c") * F.col("h")).otherwise(
        F.col("c") * F.try_divide(1 - power, 1 - F.col("phi"))
    )
    return steps.withColumn("f", drift + power * F.col("x_last"))


def ar1_forecast(panel: DataFrame, horizon: int, freq: str = "month") -> DataFrame:
    """AR(1) on the transformed series, inverted to levels: built-in operators and one shuffle by series."""
    steps = ar1_path(ar1_fit(stationary(panel)), horizon)
    ds = future(F.col("last_ds"), F.col("h"), freq)
    kept = steps.select(*KEYS, "tcode", "h", ds.alias("ds"), "f", "last", "prev")
    return to_levels(kept).select(*KEYS, "tcode", "h", "ds", "f", "value")


def naive(panel: DataFrame, horizon: int, rule: str = "last", x: str = "value", freq: str = "month") -> DataFrame:
    """The last observation, or the mean, at every step."""
    value = F.max_by(x, F.when(F.col(x).isNotNull(), F.col("t"))) if rule == "last" else F.avg(x)
    base = panel.groupBy(*KEYS).agg(value.alias("f"), F.max("ds").alias("_last")).filter("f is not null")
    steps = base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(*KEYS, "h", future(F.col("_last"), F.col("h"), freq).alias("ds"), "f")


def pack(panel: DataFrame, x: str = "x", value: str = "value") -> DataFrame:
    """One row per series: observed ``x`` in time order, the last two levels, code and last date."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("t", c)))), lambda s: s[c])
    rows = panel.groupBy(*KEYS).agg(
        in_order(x).alias("y"), in_order(value).alias("_levels"), F.max("tcode").alias("tcode"), F.max("ds").alias("last_ds")
    )
    tail = lambda i: F.try_element_at("_levels", F.lit(i))
    return rows.select(*KEYS, "y", tail(-1).alias("last"), tail(-2).alias("prev"), "tcode", "last_ds")


def _mean(y: str = "y") -> Column:
    return F.try_divide(F.aggregate(y, F.lit(0.0), lambda a, v: a + v), F.size(y))


def settled(packed: DataFrame) -> DataFrame:
    """Packed series, checkpointed and dealt by series: a fit goes through them more than once, and no window of a
    series deals them again.

    A checkpoint forgets how its rows were dealt, so they are dealt behind it, still packed, to tasks of about
    ``CELLS`` values; adaptive execution does not merge these.
    """
    if getattr(packed, "_settled", False):
        return packed
    kept = cut_lineage(spread(packed, *KEYS))
    cells = kept.agg(F.sum(F.size("y"))).first()[0] or 0
    parts = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells / CELLS))
    return _marked(kept.repartition(parts, *KEYS))


def _marked(df: DataFrame) -> DataFrame:
    df._settled = True
    return df


def fit_ar(packed: DataFrame, horizon: int, lags: int | None = None, max_lags: int = 12) -> DataFrame:
    """AR by least squares with a constant; ``lags=None`` picks the order from the partial autocorrelations.

    A series has at most a third of its length in lags; a failed fit forecasts the mean.
    """
    packed = settled(packed)
    rows = arma.observations(packed)
    if lags is None:
        partial = partial_autocorrelations(autocorrelation(rows.withColumn("t", F.col("i")), max_lag=max_lags))
        chosen = choose_order(partial, max_lags)
    else:
        chosen = packed.select(*KEYS, F.size("y").alias("n"), F.lit(lags).alias("order"))
    p = F.greatest(F.lit(1), F.least("order", F.floor(F.col("n") / 3).cast("int")))
    sums = arma.lag_moments(rows.join(chosen.select(*KEYS, p.alias("_order")), KEYS), lags or max_lags, "_order")
    fits = arma.with_model(sums, F.col("_order"), F.lit(0), lags or max_lags, horizon, damped=False)
    fits = fits.select(*KEYS, _levels(F.col("model"), F.col("_order").cast("string")).alias("_fit"))
    return _guarded(packed.join(fits, KEYS, "left"), "ar", F.array_repeat(_mean(), horizon))


def _levels(model: Column, order: Column) -> Column:
    """Fit of a scaled model: its path in the units of the series."""
    path = F.transform(model["path"], lambda v: F.col("mu") + F.col("sd") * v)
    return F.struct(order.alias("order"), path.alias("path"), model["aic"].alias("aic"), F.when(model.isNotNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"))


def fit_ma(packed: DataFrame, horizon: int, order: int | None = None, max_order: int = 12) -> DataFrame:
    """MA with a constant by two regressions (see ``arma``); a failed fit forecasts the mean.

    Without ``order`` it is chosen from the autocorrelations; a series has at most a quarter of its length.
    """
    packed = settled(packed)
    rows = arma.observations(packed)
    if order is None:
        chosen = choose_order(autocorrelation(rows.withColumn("t", F.col("i")), max_lag=max_order), max_order)
    else:
        chosen = packed.select(*KEYS, F.size("y").alias("n"), F.lit(order).alias("order"))
    q = F.greatest(F.lit(1), F.least("order", F.floor(F.col("n") / 4).cast("int")))
    sums = arma.moments(rows.join(chosen.select(*KEYS, q.alias("_order")), KEYS), 0, order or max_order, "_order")
    fits = arma.with_model(sums, F.lit(0), F.col("_order"), 0, horizon)
    fits = fits.select(*KEYS, _levels(F.col("model"), F.concat(F.lit("0,0,"), F.col("_order"))).alias("_fit"))
    return _guarded(packed.join(fits, KEYS, "left"), "ma", F.array_repeat(_mean(), horizon))


def fit_arima(
    packed: DataFrame, horizon: int, order: tuple[int, int, int] | None = None, max_p: int = 3, max_q: int = 3
) -> DataFrame:
    """ARIMA of a given order, or the one of least AIC over all p and q except (0, 0); a failed fit repeats the last value.

    A model of differences has no constant.
    """
    packed = settled(packed)
    if order is None:
        best = arima_grid(packed, horizon, max_p, max_q).groupBy(*KEYS).agg(F.min_by("fit", F.struct("aic", "p", "q")).alias("_fit"))
    else:
        p, d, q = order
        sums = arma.moments(arma.observations(packed, d), p, q, centred=d == 0)
        fits = arma.with_model(sums, F.lit(p), F.lit(q), p, horizon, const=d == 0)
        best = _undifferenced(fits.select(*KEYS, _levels(F.col("model"), F.lit(f"{p},{d},{q}")).alias("_fit")), packed, d)
    return _guarded(packed.join(best, KEYS, "left"), "arima", F.array_repeat(F.try_element_at("y", F.lit(-1)), horizon))


def _undifferenced(fits: DataFrame, packed: DataFrame, d: int) -> DataFrame:
    """Paths summed up ``d`` times, each time from the last value of that difference."""
    if not d:
        return fits
    both = fits.join(packed.select(*KEYS, "y"), KEYS)
    path, differences = F.col("_fit.path"), [F.col("y")]
    for _ in range(d - 1):
        y = differences[-1]
        differences.append(F.zip_with(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), F.slice(y, 1, F.greatest(F.size(y) - 1, F.lit(0))), lambda b, a: b - a))
    for y in reversed(differences):
        base = F.try_element_at(y, F.lit(-1))
        path = F.slice(F.aggregate(path, F.array(base), lambda done, v: F.array_append(done, F.element_at(done, -1) + v)), 2, F.size(path))
    return both.select(*KEYS, F.struct(F.col("_fit.order").alias("order"), path.alias("path"), F.col("_fit.aic").alias("aic"), F.col("_fit.status").alias("status")).alias("_fit"))


def arima_grid(packed: DataFrame, horizon: int, max_p: int = 3, max_q: int = 3) -> DataFrame:
    """AIC and forecast path of every order for every series; failed fits are left out.

    All orders come from the same sums of a series, so trying one more neither copies nor reads the series again.
    """
    rows = arma.observations(settled(packed).filter(F.size("y") >= MIN_OBS["arima"]))
    sums = arma.moments(rows, max_p, max_q)
    orders = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(max_p + 1) for q in range(max_q + 1) if (p, q) != (0, 0)])
    fits = arma.with_model(sums.select("*", F.inline(orders)), F.col("p"), F.col("q"), max_p, horizon)
    # a filter on the model would be worked out once more below it
    found = fits.select(*KEYS, "p", "q", "mu", "sd", F.explode(F.filter(F.array("model"), lambda m: m.isNotNull())).alias("model"))
    return found.select(*KEYS, "p", "q", F.col("model.aic").alias("aic"), _levels(F.col("model"), F.concat_ws(",", "p", F.lit(0), "q")).alias("fit"))


def _guarded(df: DataFrame, model: str, fallback: Column) -> DataFrame:
    """NULL path for short series, the fallback for failed fits."""
    n = F.size("y")
    none = F.array_repeat(F.lit(None).cast("double"), F.size(fallback))
    ok = F.col("_fit.status") == "ok"
    short = n < MIN_OBS[model]
    fit = F.struct(
        F.when(ok & ~short, F.col("_fit.order")).alias("order"),
        F.when(short, none).when(ok, F.col("_fit.path")).otherwise(fallback).alias("path"),
        F.when(ok & ~short, F.col("_fit.aic")).alias("aic"),
        F.when(short, F.lit("short")).when(ok, F.lit("ok")).otherwise(F.lit("fallback")).alias("status"),
    )
    return df.withColumn("fit", fit).drop("_fit")


def fleet_levels(fitted: DataFrame, model: str, freq: str = "month") -> DataFrame:
    """Forecast levels, one row per series and step, dated by the periods after the last row."""
    path = level_path(F.col("fit.path"), F.col("last"), F.col("prev"), F.col("tcode"))
    rows = fitted.select(
        *KEYS, F.lit(model).alias("model"), F.col("fit.order").alias("order"), F.col("fit.status").alias("status"), "last_ds",
        F.posexplode(path).alias("_i", "value"),
    )
    h = F.col("_i") + 1
    return rows.select(*KEYS, "model", "order", "status", h.alias("h"), future(F.col("last_ds"), h, freq).alias("ds"), "value")


def fleet(packed: DataFrame, horizon: int, models: Sequence[str] = ("ar", "ma", "arima"), freq: str = "month") -> DataFrame:
    """Forecasts of several models in one table, dated by ``freq``; the ARIMA orders are chosen by AIC."""
    packed = settled(packed)
    makers = {"ar": fit_ar, "ma": fit_ma, "arima": fit_arima}
    tables = [fleet_levels(makers[m](packed, horizon), m, freq) for m in models]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out
