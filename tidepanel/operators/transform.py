"""Per-series transforms: stationarity codes, standardising, indexing to 100, period changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import safe_log
from tidepanel.panel import KEYS, by_time


def stationary(panel: DataFrame, value: str = "value", out: str = "x", unknown: str = "pass") -> DataFrame:
    """Apply each row's ``tcode``.

    1 level, 2 difference, 3 second difference, 4 log, 5 log difference, 6 second log difference,
    7 difference of the relative change. A neighbour that is missing, or non-positive under a log,
    gives NULL. All codes share two lags, so the whole panel is one window pass.
    """
    w = by_time()
    v, p, q = F.col(value), F.col("_lag1"), F.col("_lag2")
    lv, lp, lq = safe_log(v), safe_log(p), safe_log(q)
    other = v if unknown == "pass" else F.raise_error(F.concat(F.lit("unknown code of "), F.col("series"))).cast("double")
    code = F.col("tcode")
    x = (
        F.when(code == 1, v)
        .when(code == 2, v - p)
        .when(code == 3, v - 2 * p + q)
        .when(code == 4, lv)
        .when(code == 5, lv - lp)
        .when(code == 6, lv - 2 * lp + lq)
        .when(code == 7, F.try_divide(v, p) - F.try_divide(p, q))
        .otherwise(other)
    )
    lagged = panel.withColumns({"_lag1": F.lag(value, 1).over(w), "_lag2": F.lag(value, 2).over(w)})
    return lagged.withColumn(out, x).drop("_lag1", "_lag2")


def _deviation(col: str, ddof: int) -> Column:
    return F.stddev_samp(col) if ddof == 1 else F.stddev_pop(col)


def moments(panel: DataFrame, x: str = "x", ddof: int = 1) -> DataFrame:
    """Count, mean and deviation per series."""
    return panel.groupBy(*KEYS).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), _deviation(x, ddof).alias("sigma"))


def usable_scale(mu: Column, sigma: Column) -> tuple[Column, Column]:
    """A missing mean counts as 0, a zero or missing deviation as 1."""
    return F.coalesce(mu, F.lit(0.0)), F.when(sigma > 0, sigma).otherwise(F.lit(1.0))


def standardize(panel: DataFrame, x: str = "x", out: str = "z", ddof: int = 1) -> DataFrame:
    """Add ``mu``, ``sigma`` and the standardised value; no shuffle beyond the one by series."""
    w = Window.partitionBy(*KEYS)
    mu, sigma = usable_scale(F.col("_mu"), F.col("_sd"))
    return (
        panel.withColumns({"_mu": F.avg(x).over(w), "_sd": _deviation(x, ddof).over(w)})
        .withColumns({"mu": mu, "sigma": sigma})
        .withColumn(out, (F.col(x) - F.col("mu")) / F.col("sigma"))
        .drop("_mu", "_sd")
    )


def unstandardize(panel: DataFrame, scale: DataFrame, z: str = "z", out: str = "x") -> DataFrame:
    mu, sigma = usable_scale(F.col("mu"), F.col("sigma"))
    return panel.join(scale.select(*KEYS, "mu", "sigma"), KEYS).withColumn(out, F.col(z) * sigma + mu)


def index_to_100(panel: DataFrame, value: str = "value", out: str = "index_100") -> DataFrame:
    """Rescale each series so that its first observed value is 100; a zero start gives NULL."""
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.first(value, ignorenulls=True).over(w)
    return panel.withColumn(out, F.try_divide(F.col(value) * 100, start))


def period_change(panel: DataFrame, value: str = "value") -> DataFrame:
    """Change and percent change against the previous row."""
    before = F.lag(value).over(by_time())
    return (
        panel.withColumn("_before", before)
        .withColumns({
            "chg": F.col(value) - F.col("_before"),
            "pct": (F.try_divide(F.col(value), F.col("_before")) - 1) * 100,
        })
        .drop("_before")
    )
