"""Summaries of forecasts and their scores against history and actuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import correlation, pct_of, range_label, rounded, safe_log, trend_label
from tidepanel.operators.transform import period_change
from tidepanel.panel import KEYS

MONTHS = 12


def _ordered(*extra: str) -> Window:
    return Window.partitionBy(*KEYS, *extra).orderBy("ds")


def summarize(forecast: DataFrame) -> DataFrame:
    """Range, moments, change and trend of each forecast series."""
    seen = forecast.filter("value is not null")
    base = seen.groupBy(*KEYS).agg(
        F.min("ds").alias("start_date"),
        F.max("ds").alias("end_date"),
        F.count(F.lit(1)).alias("n_periods"),
        F.min_by("value", "ds").alias("_first"),
        F.max_by("value", "ds").alias("_last"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_std"),
    )
    change = F.col("_last") - F.col("_first")
    pct = pct_of(change, F.col("_first"))
    return base.select(
        *KEYS, "start_date", "end_date", "n_periods",
        rounded(F.col("_first"), 4).alias("first_value"),
        rounded(F.col("_last"), 4).alias("last_value"),
        rounded(F.col("_min"), 4).alias("min"),
        rounded(F.col("_max"), 4).alias("max"),
        rounded(F.col("_mean"), 4).alias("mean"),
        rounded(F.col("_std"), 4).alias("std"),
        rounded(change, 4).alias("total_change"),
        rounded(pct, 2).alias("pct_change"),
        trend_label(pct).alias("trend"),
    )


def growth_rates(forecast: DataFrame) -> DataFrame:
    """Mean and spread of period growth: log returns, or percent changes once a series has a non-positive value."""
    w = _ordered()
    seen = forecast.filter("value is not null")
    marked = seen.withColumns({
        "_before": F.lag("value").over(w),
        "_mixed": F.bool_or(F.col("value") <= 0).over(Window.partitionBy(*KEYS)),
    })
    ratio = F.try_divide(F.col("value"), F.col("_before")) - 1
    logs = safe_log(F.col("value")) - safe_log(F.col("_before"))
    marked = marked.withColumn("_r", F.when(F.col("_mixed"), ratio).otherwise(logs) * 100)
    stats = (
        marked.filter("_r is not null")
        .groupBy(*KEYS)
        .agg(
            F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.min("_r").alias("_lo"), F.max("_r").alias("_hi"),
            F.bool_or("_mixed").alias("_mixed"),
        )
    )
    return stats.select(
        *KEYS,
        rounded(F.col("_m"), 4).alias("avg_monthly_growth_pct"),
        rounded(F.col("_m") * MONTHS, 4).alias("avg_annual_growth_pct"),
        rounded(F.col("_s"), 4).alias("volatility_monthly_pct"),
        rounded(F.col("_s") * F.sqrt(F.lit(float(MONTHS))), 4).alias("volatility_annual_pct"),
        rounded(F.col("_lo"), 4).alias("min_monthly_pct"),
        rounded(F.col("_hi"), 4).alias("max_monthly_pct"),
        F.when(F.col("_mixed"), F.lit("pct_change")).otherwise(F.lit("log_return")).alias("method"),
    )


def month_over_month(forecast: DataFrame) -> DataFrame:
    """Value, change and percent change per period."""
    w = Window.partitionBy(*KEYS).orderBy("ds")
    if "t" not in forecast.columns:
        forecast = forecast.withColumn("t", F.row_number().over(w))
    return period_change(forecast)


def compare_to_history(forecast: DataFrame, history: DataFrame, lookback: int = 24) -> DataFrame:
    """Forecast moments against those of the last ``lookback`` observations.

    The forecast counts as in range when it stays within 10% of the historic extremes, or, once these go
    below zero, within 10% of the historic range around them.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("ds"))
    recent = history.filter("value is not null").withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= lookback)
    h = recent.groupBy(*KEYS).agg(
        F.max_by("value", "ds").alias("h_last"), F.avg("value").alias("h_mean"), F.stddev_samp("value").alias("h_std"),
        F.min("value").alias("h_min"), F.max("value").alias("h_max"),
    )
    f = forecast.filter("value is not null").groupBy(*KEYS).agg(
        F.min_by("value", "ds").alias("f_first"), F.avg("value").alias("f_mean"), F.stddev_samp("value").alias("f_std"),
        F.min("value").alias("f_min"), F.max("value").alias("f_max"),
    )
    c = F.col
    size = c("h_max") - c("h_min")
    lo = F.when(c("h_min") >= 0, c("h_min") * 0.9).otherwise(c("h_min") - size * 0.1)
    hi = F.when(c("h_min") >= 0, c("h_max") * 1.1).otherwise(c("h_max") + size * 0.1)
    inside = (c("f_min") >= lo) & (c("f_max") <= hi)
    return f.join(h, KEYS).select(
        *KEYS,
        rounded(c("h_last"), 2).alias("hist_last"),
        rounded(c("f_first"), 2).alias("fcst_first"),
        rounded(pct_of(c("f_first") - c("h_last"), c("h_last")), 2).alias("jump_pct"),
        rounded(c("h_mean"), 2).alias("hist_mean"),
        rounded(c("f_mean"), 2).alias("fcst_mean"),
        rounded(pct_of(c("f_mean") - c("h_mean"), c("h_mean")), 2).alias("mean_shift_pct"),
        rounded(c("h_std"), 2).alias("hist_std"),
        rounded(c("f_std"), 2).alias("fcst_std"),
        range_label(c("h_min"), c("h_max")).alias("hist_range"),
        range_label(c("f_min"), c("f_max")).alias("fcst_range"),
        F.when(inside, F.lit("Yes")).otherwise(F.lit("No")).alias("in_hist_range"),
    )


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """Errors of matched ``forecast``/``actual`` pairs per series (and ``by``); zero actuals do not enter MAPE."""
    f, a = F.col("forecast"), F.col("actual")
    err = f - a
    stats = pairs.groupBy(*KEYS, *by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg(err).alias("_me"),
        F.avg(F.abs(err)).alias("_mae"),
        F.sqrt(F.avg(err * err)).alias("_rmse"),
        F.avg(F.abs(F.try_divide(err, a)) * 100).alias("_mape"),
        correlation(f, a).alias("_corr"),
    )
    return stats.select(
        *KEYS, *by, "n_obs",
        rounded(F.col("_me"), 4).alias("me"),
        rounded(F.col("_mae"), 4).alias("mae"),
        rounded(F.col("_rmse"), 4).alias("rmse"),
        rounded(F.col("_mape"), 2).alias("mape_pct"),
        rounded(F.col("_corr"), 4).alias("correlation"),
        F.when(F.col("_me") > 0, F.lit("over")).otherwise(F.lit("under")).alias("bias_direction"),
    )


def metrics_table(pairs: DataFrame, models: list[str], sort_by: str = "series", descending: bool = False) -> DataFrame:
    """One row per series with rmse, mape and correlation of every model, sorted, empty values last."""
    f, a = F.col("forecast"), F.col("actual")
    err = f - a
    scored = pairs.groupBy(*KEYS).pivot("model", models).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(F.try_divide(err, a)) * 100).alias("mape"),
        correlation(f, a).alias("correlation"),
    )
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return scored.orderBy(order)


def quick_look(forecast: DataFrame, meta: DataFrame, n_series: int = 10) -> DataFrame:
    """First and last value and percent change of the first series by position."""
    first = meta.select(*KEYS, "pos").filter(F.col("pos") <= n_series)
    ends = forecast.join(first, KEYS).groupBy(*KEYS, "pos").agg(
        F.min_by("value", "ds").alias("_first"), F.max_by("value", "ds").alias("_last")
    )
    return ends.select(
        *KEYS, "pos",
        rounded(F.col("_first"), 2).alias("first_value"),
        rounded(F.col("_last"), 2).alias("last_value"),
        rounded(pct_of(F.col("_last") - F.col("_first"), F.col("_first")), 2).alias("pct_change"),
    )


def series_detail(forecast: DataFrame, history: DataFrame, series: str) -> DataFrame:
    """Level, growth and history figures of one series in one row."""
    f = forecast.filter(F.col("series") == series)
    h = history.filter(F.col("series") == series)
    w = _ordered()
    seen = f.filter("value is not null").withColumn(
        "_g", (F.try_divide(F.col("value"), F.lag("value").over(w)) - 1) * 100
    )
    growth = seen.groupBy(*KEYS).agg(
        rounded(F.avg("_g"), 4).alias("growth_mean"), rounded(F.stddev_samp("_g"), 4).alias("growth_std"),
        rounded(F.min("_g"), 4).alias("growth_min"), rounded(F.max("_g"), 4).alias("growth_max"),
    )
    level = summarize(f).drop("start_date", "end_date", "trend")
    past = compare_to_history(f, h).select(*KEYS, "hist_mean", "hist_std", "hist_last", "fcst_first")
    return level.join(growth, KEYS).join(past, KEYS, "left")


def kpi_report(summary: DataFrame) -> DataFrame:
    """Largest rise and fall and the number of series that go up, down or stay flat, per panel."""
    known = summary.filter("pct_change is not null")
    pct = F.col("pct_change")
    rise = F.struct(pct.alias("p"), F.col("series").alias("s"))
    top, bottom = F.max(rise), F.min(rise)
    up, down = F.count_if(pct > 1), F.count_if(pct < -1)
    return known.groupBy("panel_id").agg(
        top["s"].alias("largest_rise"), top["p"].alias("rise_pct"),
        bottom["s"].alias("largest_fall"), bottom["p"].alias("fall_pct"),
        up.alias("n_up"), down.alias("n_down"), (F.count(F.lit(1)) - up - down).alias("n_flat"),
    )


def plot_rows(history: DataFrame, forecast: DataFrame, lookback: int = 60) -> DataFrame:
    """The last ``lookback`` observations of each series and its forecast, labelled."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("ds"))
    recent = (
        history.filter("value is not null")
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= lookback)
    )
    return recent.select(*KEYS, "ds", "value", F.lit("historical").alias("kind")).unionByName(
        forecast.filter("value is not null").select(*KEYS, "ds", "value", F.lit("forecast").alias("kind"))
    )


def status_counts(results: DataFrame, *by: str) -> DataFrame:
    """How many series of a fleet succeeded or failed, and why."""
    return results.groupBy(*by, "status").agg(F.countDistinct(*KEYS).alias("n_series"))
