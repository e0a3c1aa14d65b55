"""Missing cells: interpolation, carrying values, mean filling, gap reports, model-ready panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.transform import standardize
from tidepanel.panel import KEYS, by_time, with_panel_range


def _neighbours(panel: DataFrame, value: str) -> DataFrame:
    """Attach the nearest observed cell on each side as ``_p`` and ``_q`` (t, ds, v)."""
    w = by_time()
    cell = F.when(F.col(value).isNotNull(), F.struct("t", "ds", F.col(value).alias("v")))
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return panel.withColumns({
        "_p": F.last(cell, ignorenulls=True).over(back),
        "_q": F.first(cell, ignorenulls=True).over(ahead),
    })


def _between(position: Column, lo: Column, hi: Column) -> Column:
    share = F.try_divide(position - lo, hi - lo)
    return F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * share


def interpolate_first(panel: DataFrame, value: str = "value", out: str | None = None, limit: int = 3) -> DataFrame:
    """Fill the first ``limit`` cells of every gap on a line weighted by calendar time.

    Cells after the last observation take its value, also for ``limit`` cells; leading cells stay empty.
    """
    joined = _neighbours(panel, value)
    when = lambda c: F.unix_seconds(c.cast("timestamp"))
    line = _between(when(F.col("ds")), when(F.col("_p.ds")), when(F.col("_q.ds")))
    filled = F.when(F.col("_q").isNull(), F.col("_p.v")).otherwise(line)
    near = F.col("_p").isNotNull() & (F.col("t") - F.col("_p.t") <= limit)
    new = F.coalesce(F.col(value), F.when(near, filled))
    return joined.withColumn(out or value, new).drop("_p", "_q")


def interpolate_short(panel: DataFrame, value: str = "value", out: str | None = None, max_gap: int = 3) -> DataFrame:
    """Fill interior gaps of at most ``max_gap`` cells on a line weighted by row position; leave longer ones."""
    joined = _neighbours(panel, value)
    line = _between(F.col("t"), F.col("_p.t"), F.col("_q.t"))
    short = F.col("_q.t") - F.col("_p.t") - 1 <= max_gap
    new = F.coalesce(F.col(value), F.when(short, line))
    return joined.withColumn(out or value, new).drop("_p", "_q")


def carry(panel: DataFrame, value: str = "value", out: str | None = None, backward: bool = True) -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    w = by_time()
    forward = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not backward:
        return panel.withColumn(out or value, forward)
    behind = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return panel.withColumn(out or value, F.coalesce(forward, behind))


def fill_mean(panel: DataFrame, value: str = "z", out: str | None = None) -> DataFrame:
    mean = F.avg(value).over(Window.partitionBy(*KEYS))
    return panel.withColumn(out or value, F.coalesce(F.col(value), mean))


def ragged_edge(panel: DataFrame, value: str = "value") -> DataFrame:
    """Series that end before their panel: last observed position, first missing one, count."""
    ends = panel.groupBy(*KEYS).agg(
        F.max(F.when(F.col(value).isNotNull(), F.col("t"))).alias("last_valid"), F.max("t").alias("_end")
    )
    return ends.filter("last_valid < _end").select(
        *KEYS, "last_valid", (F.col("last_valid") + 1).alias("missing_start"), (F.col("_end") - F.col("last_valid")).alias("n_missing")
    )


def gap_cells(panel: DataFrame, value: str = "value") -> DataFrame:
    """Every missing cell after a series' first observation, labelled interior or trailing."""
    w = Window.partitionBy(*KEYS)
    seen = F.when(F.col(value).isNotNull(), F.col("t"))
    spans = panel.withColumns({"_first": F.min(seen).over(w), "_last": F.max(seen).over(w)})
    kind = F.when(F.col("t") < F.col("_last"), F.lit("interior")).otherwise(F.lit("trailing"))
    return spans.filter(F.col(value).isNull() & (F.col("t") > F.col("_first"))).select(*KEYS, "t", "ds", kind.alias("kind"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Cells, series and periods affected, per panel and kind."""
    return gaps.groupBy("panel_id", "kind").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("series").alias("n_series"),
        F.countDistinct("t").alias("n_periods"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def most_filled(filled: DataFrame, top: int = 10) -> DataFrame:
    """The series with the most filled cells: a top-k report, ties by name."""
    counts = filled.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_filled"))
    return counts.orderBy(F.desc("n_filled"), "panel_id", "series").limit(top)


def touched_rows(filled: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows of the dates on which at least one cell was filled."""
    return filled.join(gaps.select("panel_id", "ds").distinct(), ["panel_id", "ds"], "left_semi")


def model_ready(
    panel: DataFrame, x: str = "x", min_obs_ratio: float = 0.8, rule: str = "short", drop_leading: bool = False
) -> DataFrame:
    """Cut the two rows lost to differencing, keep well-observed series, fill gaps, standardise.

    ``rule`` is ``short`` (gaps of at most three cells) or ``first`` (three cells of any gap);
    ``drop_leading`` also cuts the rows before the first one with any observation. A series with a missing
    share of ``1 - min_obs_ratio`` or more is left out.
    """
    cut = panel.filter("t > 2")
    if drop_leading:
        seen = F.when(F.col(x).isNotNull(), F.col("t"))
        cut = with_panel_range(cut, seen, "_start", "_end").filter("t >= _start").drop("_start", "_end")
    missing = F.avg(F.col(x).isNull().cast("double")).over(Window.partitionBy(*KEYS))
    kept = cut.withColumn("_missing", missing).filter(F.col("_missing") < F.lit(1.0) - min_obs_ratio).drop("_missing")
    filled = interpolate_short(kept, x) if rule == "short" else interpolate_first(kept, x)
    whole = carry(filled, x).filter(F.col(x).isNotNull())
    return standardize(whole, x)
