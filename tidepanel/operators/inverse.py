"""From transformed forecasts back to levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import safe_log
from tidepanel.panel import KEYS, by_time

RECENT = 12  # rows that define the recent trend of a series
BLEND = 0.7  # weight of the forecast against that trend


def with_previous_level(panel: DataFrame, value: str = "value") -> DataFrame:
    """Attach the observed level before each row as ``_level_before``."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    return panel.withColumn("_level_before", F.last(value, ignorenulls=True).over(before))


def anchor_aggregates(value: str = "value") -> list[Column]:
    """Aggregates over ``with_previous_level`` rows for the last and last-but-one observed level."""
    at = F.when(F.col(value).isNotNull(), F.col("t"))
    return [F.max_by(value, at).alias("last"), F.max_by("_level_before", at).alias("prev")]


def anchors(levels: DataFrame, value: str = "value") -> DataFrame:
    """Last and last-but-one observed level of each series."""
    return with_previous_level(levels, value).groupBy(*KEYS).agg(*anchor_aggregates(value))


def to_levels(
    forecast: DataFrame, anchor: DataFrame | None = None, f: str = "f", out: str = "value", guard: str = "null", path: tuple[str, ...] = ()
) -> DataFrame:
    """Invert forecasts ``(series, h, f, tcode)`` step by step through running sums and products.

    A NULL step stays NULL and the path goes on from where it was. With ``guard='null'`` an anchor that
    cannot be used (absent, non-positive under a log, zero under code 7) gives NULL; ``'repeat'`` gives
    the last level. ``path`` names further columns that tell forecast paths apart. Without ``anchor`` the
    forecast rows carry ``last`` and ``prev`` themselves.
    """
    steps = (
        Window.partitionBy(*KEYS, *path).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last, prev, code, val = F.col("last"), F.col("prev"), F.col("tcode"), F.col(f)
    if guard == "repeat":
        prev = F.coalesce(prev, last)
    given = val.isNotNull()
    anchored = forecast if anchor is None else forecast.join(anchor, KEYS, "left")
    joined = anchored.withColumns({"_c1": F.sum(f).over(steps), "_n": F.count(f).over(steps)})
    growth = F.try_divide(last - prev, prev)
    joined = joined.withColumns({
        "_c2": F.sum(F.when(given, F.col("_c1"))).over(steps),
        "_prod": F.product(F.when(given, 1 + growth + F.col("_c1"))).over(steps),
    })
    c1, n, c2 = F.col("_c1"), F.col("_n"), F.col("_c2")
    log_last, log_prev = safe_log(last), safe_log(prev)
    level = (
        F.when(code == 2, last + c1)
        .when(code == 3, last + n * (last - prev) + c2)
        .when(code == 4, F.exp(val))
        .when(code == 5, F.exp(log_last + c1))
        .when(code == 6, F.exp(log_last + n * (log_last - log_prev) + c2))
        .when(code == 7, last * F.col("_prod"))
        .otherwise(val)
    )
    if guard == "repeat":
        level = F.coalesce(level, last)
    elif guard != "null":
        raise ValueError(f"unknown guard {guard!r}")
    level = F.when(given & last.isNotNull(), level)
    return joined.withColumn(out, level).drop("_c1", "_n", "_c2", "_prod", "last", "prev")


def next_level(val: Column, last: Column, prev: Column, code: Column) -> Column:
    """One step ahead for one simulated value; unusable anchors repeat the last level."""
    prev = F.coalesce(prev, last)
    step = (
        F.when(code == 2, last + val)
        .when(code == 3, 2 * last - prev + val)
        .when(code == 4, F.exp(val))
        .when(code == 5, F.when(last > 0, last * F.exp(val)).otherwise(last))
        .when(code == 6, F.when((last > 0) & (prev > 0), last * F.exp(F.log(last) - F.log(prev) + val)).otherwise(last))
        .when(code == 7, F.when(prev != 0, last * (F.try_divide(last, prev) + val)).otherwise(last))
        .otherwise(val)
    )
    return F.when(last.isNotNull() & val.isNotNull(), step)


def recent_trend(levels: DataFrame, value: str = "value", recent: int = RECENT) -> DataFrame:
    """Growth, acceleration and relative growth over the newest observations, with mean and deviation of all."""
    observed = levels.filter(F.col(value).isNotNull())
    newest_first = Window.partitionBy(*KEYS).orderBy(F.desc("t"))
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    ranked = observed.withColumn("_rank", F.row_number().over(newest_first))
    in_window = F.col("_rank") <= recent
    ranked = ranked.withColumn("_log", F.when(in_window, safe_log(F.col(value)))).withColumn(
        "_pct", F.when(in_window & (F.col("_rank") < F.least(F.lit(recent), F.count(F.lit(1)).over(Window.partitionBy(*KEYS)))),
                       F.try_divide(F.col(value), F.lag(value).over(by_time())) - 1)
    )
    ranked = ranked.withColumn("_dlog", F.col("_log") - F.last("_log", ignorenulls=True).over(before))
    ranked = ranked.withColumn("_ddlog", F.col("_dlog") - F.last("_dlog", ignorenulls=True).over(before))
    return ranked.groupBy(*KEYS).agg(
        F.count(F.when(in_window, F.lit(1))).alias("n_recent"),
        F.count("_log").alias("n_positive"),
        F.avg("_dlog").alias("growth"),
        F.avg("_ddlog").alias("acceleration"),
        F.avg("_pct").alias("relative_growth"),
        F.avg(value).alias("level_mean"),
        F.stddev_samp(value).alias("level_sd"),
    )


def blended_level(forecast: DataFrame, anchor: DataFrame, trend: DataFrame, f: str = "f", out: str = "value") -> DataFrame:
    """One-step inverse that leans 30% on the recent trend for codes 5-7, clipped to five deviations for codes 4-7."""
    j = forecast.join(anchor, KEYS).join(trend, KEYS)
    val, last, code = F.col(f), F.col("last"), F.col("tcode")
    prev = F.coalesce(F.col("prev"), last)
    plain = next_level(val, last, prev, code)
    fc, own = BLEND * val, 1 - BLEND
    log_step = F.log(last) - F.log(prev)
    pct_step = F.try_divide(last, prev) - 1
    blend = (
        F.when((code == 5) & (last > 0) & (F.col("n_recent") >= 3) & (F.col("n_positive") >= 3),
               last * F.exp(fc + own * F.col("growth")))
        .when((code == 6) & (last > 0) & (prev > 0) & (F.col("n_recent") >= 4) & (F.col("n_positive") >= 4),
              last * F.exp(log_step + fc + own * F.col("acceleration")))
        .when((code == 7) & (prev != 0) & (F.col("n_recent") >= 4) & F.col("relative_growth").isNotNull(),
              last * (1 + pct_step + fc + own * (F.col("relative_growth") - pct_step)))
        .otherwise(plain)
    )
    lo = F.col("level_mean") - 5 * F.col("level_sd")
    hi = F.col("level_mean") + 5 * F.col("level_sd")
    clipped = F.when((code >= 4) & (F.col("level_sd") > 0), F.greatest(F.least(blend, hi), lo)).otherwise(blend)
    return j.withColumn(out, F.when(val.isNotNull(), clipped)).select(*forecast.columns, out)


def level_path(path: Column, last: Column, prev: Column, code: Column) -> Column:
    """The same inverse for a forecast held as one array per series: no shuffle, no sort.

    ``path`` is an array of transformed forecasts in step order; the result is the array of levels.
    """
    slope = last - prev
    log_last, log_slope = safe_log(last), safe_log(last) - safe_log(prev)
    growth = F.try_divide(slope, prev)
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("n"), zero.alias("c1"), zero.alias("c2"), F.lit(1.0).alias("prod"), F.array().cast("array<double>").alias("out")
    )

    def level(c1: Column, c2: Column, n: Column, prod: Column, f: Column) -> Column:
        return (
            F.when(code == 2, last + c1)
            .when(code == 3, last + n * slope + c2)
            .when(code == 4, F.exp(f))
            .when(code == 5, F.exp(log_last + c1))
            .when(code == 6, F.exp(log_last + n * log_slope + c2))
            .when(code == 7, last * prod)
            .otherwise(f)
        )

    def advance(acc: Column, f: Column) -> Column:
        n, c1 = acc["n"] + 1, acc["c1"] + f
        c2, prod = acc["c2"] + c1, acc["prod"] * F.coalesce(1 + growth + c1, F.lit(1.0))
        usable = F.when(code == 7, level(c1, c2, n, F.when(growth.isNotNull(), prod), f)).otherwise(level(c1, c2, n, prod, f))
        value = F.when(last.isNotNull(), usable)
        stepped = F.struct(
            n.alias("n"), c1.alias("c1"), c2.alias("c2"), prod.alias("prod"), F.concat(acc["out"], F.array(value)).alias("out")
        )
        held = F.struct(
            acc["n"].alias("n"), acc["c1"].alias("c1"), acc["c2"].alias("c2"), acc["prod"].alias("prod"),
            F.concat(acc["out"], F.array(F.lit(None).cast("double"))).alias("out"),
        )
        return F.when(f.isNotNull(), stepped).otherwise(held)

    return F.aggregate(path, start, advance, lambda acc: acc["out"])
