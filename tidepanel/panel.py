"""The long panel: its keys, its calendar and its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["panel_id", "series"]

#: Parts (a power of two) that the series of a panel are dealt into when a number of the whole panel is put beside its rows.
SHARDS = 4096

STEP = {
    "month": "INTERVAL 1 MONTH",
    "day": "INTERVAL 1 DAY",
    "hour": "INTERVAL 1 HOUR",
}


def panel_name(name: str, column: str = "series") -> Column:
    """The panel's name as a value of every row.

    A bare literal would let the optimizer fold ``panel_id = panel_id`` away and join without a key, which ends
    in a cartesian product; tied to a column it stays an equality key.
    """
    return F.concat(F.lit(name), F.substring(F.col(column).cast("string"), 1, 0)).alias("panel_id")


def by_time(*extra: str) -> Window:
    """Rows of one series in time order.

    A series has at most one row per calendar period, so a window group is as long as the calendar,
    however many raw rows went into it.
    """
    return Window.partitionBy(*KEYS, *extra).orderBy("t")


def period_index(lo: Column, ds: Column, freq: str) -> Column:
    """1-based position of ``ds`` on a calendar that starts at ``lo``."""
    if freq == "month":
        months = lambda c: F.year(c) * 12 + F.month(c)
        return (months(ds) - months(lo) + 1).cast("int")
    if freq == "day":
        return (F.datediff(ds, lo) + 1).cast("int")
    if freq == "hour":
        return (F.timestamp_diff("HOUR", lo, ds) + 1).cast("int")
    raise ValueError(f"unknown frequency {freq!r}")


def unique_cells(cells: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """One row per (panel_id, series, ds), NaN turned into NULL.

    ``error`` rejects a cell that occurs twice, ``mean`` averages it.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None))
    cells = cells.withColumn("value", value)
    if on_duplicate == "mean":
        return cells.groupBy(*KEYS, "ds").agg(F.avg("value").alias("value"))
    if on_duplicate != "error":
        raise ValueError(f"unknown duplicate rule {on_duplicate!r}")
    message = F.concat(F.lit("duplicate cell: "), F.col("series"), F.lit(" "), F.col("ds").cast("string"))
    return (
        cells.groupBy(*KEYS, "ds")
        .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
        .withColumn("value", F.when(F.col("n") > 1, F.raise_error(message)).otherwise(F.col("value")))
        .drop("n")
    )


def with_panel_range(rows: DataFrame, of: Column, lo: str, hi: str) -> DataFrame:
    """Put the least and the greatest ``of`` of the whole panel (nulls aside) beside each of its rows.

    A join on the panel alone would deal a whole panel to one task, and every window by series after it would stay
    there. Rows meet the range by panel and part of its series instead; a panel has at most ``SHARDS`` parts.
    """
    # no remainder: that can be null to the optimizer, whose check would go to one of two scans and make them differ
    dealt = rows.withColumn("_shard", F.xxhash64("series").bitwiseAND(SHARDS - 1))
    panel = Window.partitionBy("panel_id")
    ranges = dealt.groupBy("panel_id", "_shard").agg(F.min(of).alias(lo), F.max(of).alias(hi))
    ranges = ranges.select("panel_id", "_shard", F.min(lo).over(panel).alias(lo), F.max(hi).over(panel).alias(hi))
    return dealt.join(ranges, ["panel_id", "_shard"]).drop("_shard")


def regularize(cells: DataFrame, freq: str = "month", parts: int | None = None) -> DataFrame:
    """Put every series of a panel on the panel's full calendar; absent periods become NULL rows.

    Each observed row emits itself plus the empty periods up to the next one, so no calendar table is
    multiplied with the series list. Only the first row of a series needs the panel's start and only
    the last one its end. ``n_periods`` keeps the length of the calendar at hand on every row.

    With ``parts`` the series are dealt to that many tasks, which adaptive execution does not merge: windows, joins
    and aggregates by series that follow stay in these tasks, so their memory is that of one part.
    """
    step = F.expr(STEP[freq])
    # The bounds read the whole cell, not only its date: with the same columns on both sides the aggregated cells
    # are shuffled once and reused, and the raw table is scanned once.
    bounded = with_panel_range(cells, F.struct("ds", "value"), "_lo", "_hi")
    bounded = bounded.withColumns({"lo": F.col("_lo.ds"), "hi": F.col("_hi.ds")}).drop("_lo", "_hi")
    if parts:
        bounded = bounded.repartition(parts, *KEYS)
    w = Window.partitionBy(*KEYS).orderBy("ds")
    first = F.row_number().over(w) == 1
    following = F.lead("ds").over(w)
    spans = (
        bounded.withColumn("from_", F.when(first, F.col("lo")).otherwise(F.col("ds")))
        .withColumn("next_", following)
        .withColumn(
            "periods",
            F.when(F.col("next_").isNull(), F.sequence("from_", "hi", step)).otherwise(
                F.filter(F.sequence("from_", "next_", step), lambda d: d < F.col("next_"))
            ),
        )
    )
    grid = spans.select(*KEYS, "lo", "hi", "ds", "value", F.explode("periods").alias("period"))
    return grid.select(
        *KEYS,
        F.col("period").alias("ds"),
        period_index(F.col("lo"), F.col("period"), freq).alias("t"),
        F.when(F.col("period") == F.col("ds"), F.col("value")).alias("value"),
        period_index(F.col("lo"), F.col("hi"), freq).alias("n_periods"),
    )


def with_meta(panel: DataFrame, meta: DataFrame, default_code: int | None = 1) -> DataFrame:
    """Attach the transform code of each series.

    A series without a code gets ``default_code``; with ``None`` it is left out.
    """
    codes = meta.select(*KEYS, F.col("tcode").cast("int").alias("tcode"))
    if default_code is None:
        return panel.join(codes.filter("tcode is not null"), KEYS)
    return panel.join(codes, KEYS, "left").withColumn("tcode", F.coalesce("tcode", F.lit(default_code)))


def panel_length(panel: DataFrame) -> DataFrame:
    """Number of calendar periods of each panel."""
    return panel.groupBy("panel_id").agg(F.max("n_periods").alias("n_periods"))
