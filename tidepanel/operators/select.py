"""Choosing series and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.panel import KEYS

# The eight series groups and their names.
GROUP_NAMES = {
    1: "Output and Income",
    2: "Labor Market",
    3: "Housing",
    4: "Consumption, Orders, and Inventories",
    5: "Money and Credit",
    6: "Interest and Exchange Rates",
    7: "Prices",
    8: "Stock Market",
}

# Other names under which three series appear in interval files.
SERIES_ALIASES = {
    "S_P500": "S&P 500",
    "S_PDivYield": "S&P div yield",
    "S_PPERatio": "S&P PE ratio",
}


def _words(spec: str) -> list[str]:
    return [word for word in (part.strip() for part in spec.split(",")) if word]


def by_names(meta: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Series of the given names. With ``strict`` an unknown name is an error raised by the job."""
    spark = meta.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "series string")
    if strict:
        known = meta.select("series").distinct()
        unknown = F.raise_error(F.concat(F.lit("unknown series: "), F.col("series")))
        wanted = (
            wanted.join(known.withColumn("_known", F.lit(True)), "series", "left")
            .withColumn("series", F.when(F.col("_known"), F.col("series")).otherwise(unknown))
            .drop("_known")
        )
        return meta.join(wanted, "series")
    return meta.join(wanted, "series", "left_semi")


def unknown_names(meta: DataFrame, names: list[str]) -> DataFrame:
    wanted = meta.sparkSession.createDataFrame([(n,) for n in names], "series string")
    return wanted.join(meta, "series", "left_anti")


def by_positions(meta: DataFrame, spec: str) -> DataFrame:
    """Series at 1-based positions such as ``"1,2,10-20"``; a reversed range counts as written forwards."""
    keep: Column = F.lit(False)
    words = _words(spec)
    if not words:
        raise ValueError("empty position list")
    highest = 0
    for word in words:
        ends = sorted(int(end) for end in word.split("-", 1))
        if ends[0] < 1:
            raise ValueError("positions start at 1")
        highest = max(highest, ends[-1])
        keep = keep | F.col("pos").between(ends[0], ends[-1])
    sizes = meta.groupBy("panel_id").agg(F.max("pos").alias("_size"))
    beyond = F.raise_error(F.format_string(f"position {highest} is beyond the %d series", F.col("_size")))
    checked = F.when(F.col("_size") >= highest, keep).otherwise(beyond.cast("boolean"))
    return meta.join(sizes, "panel_id").filter(checked).drop("_size")


def group_table(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((names or GROUP_NAMES).items()), "group_id int, group_name string")


def by_groups(meta: DataFrame, spec: str) -> DataFrame:
    """Series of groups given by id or by part of their name (any case); one part may hit several groups."""
    keep: Column = F.lit(False)
    words = _words(spec)
    if not words:
        raise ValueError("empty group list")
    for word in words:
        if word.isdigit():
            keep = keep | (F.col("group_id") == int(word))
        else:
            keep = keep | F.contains(F.lower("group_name"), F.lit(word.lower()))
    return meta.filter(keep)


def drop_groups(meta: DataFrame, group_ids: list[int]) -> DataFrame:
    return meta.filter(~F.coalesce(F.col("group_id"), F.lit(1)).isin(group_ids))


def listing(meta: DataFrame) -> DataFrame:
    """Series with position and the number of series of their panel."""
    total = meta.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n_series"))
    return meta.join(total, "panel_id").select("pos", "series", "n_series")


def group_sizes(meta: DataFrame) -> DataFrame:
    return meta.groupBy("group_id", "group_name").agg(F.count(F.lit(1)).alias("n_series"))


def search(meta: DataFrame, text: str, chosen_groups: list[int]) -> DataFrame:
    """Series whose code or description contains the text; those of chosen groups come first."""
    term = F.lit(text.lower())
    hit = F.contains(F.lower("series"), term)
    if "description" in meta.columns:
        hit = hit | F.contains(F.lower("description"), term)
    found = meta.filter(hit).withColumn("in_group", F.col("group_id").isin(chosen_groups))
    order = [F.desc("in_group"), F.when(F.col("in_group"), F.col("group_id")), F.lower("series")]
    return found.orderBy(*order)


def resolve_alias(names: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Replace alternative series names by the usual ones."""
    spark = names.sparkSession
    table = spark.createDataFrame(list((aliases or SERIES_ALIASES).items()), "series string, _usual string")
    return names.join(table, "series", "left").withColumn("series", F.coalesce("_usual", "series")).drop("_usual")


def group_or_default(group_id: Column, default: int = 1) -> Column:
    return F.coalesce(group_id, F.lit(default))


def split_holdout(panel: DataFrame, holdout: int) -> DataFrame:
    """Mark the last ``holdout`` periods of each panel; a panel that is not longer is an error."""
    if holdout < 1:
        raise ValueError("holdout must be at least 1")
    n = F.col("n_periods")
    short = F.raise_error(F.format_string(f"%d periods cannot spare {holdout}", n))
    return panel.withColumn("is_train", F.when(n > holdout, F.col("t") <= n - holdout).otherwise(short.cast("boolean")))


def history_and_holdout(panel: DataFrame, holdout: int) -> tuple[DataFrame, DataFrame]:
    """The two parts; the history's calendar ends where the holdout begins."""
    marked = split_holdout(panel, holdout)
    history = marked.filter("is_train").drop("is_train").withColumn("n_periods", F.col("n_periods") - holdout)
    return history, marked.filter(~F.col("is_train")).drop("is_train")


def usable_by_count(panel: DataFrame, x: str = "x", min_obs: int = 100) -> DataFrame:
    """Series with at least ``min_obs`` observations that are not all equal."""
    stats = panel.groupBy(*KEYS).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"))
    return stats.filter((F.col("n") >= min_obs) & (F.col("sd") > 0))


def usable_by_share(panel: DataFrame, x: str = "x", min_obs_ratio: float = 0.8) -> DataFrame:
    """Series whose missing share is below ``1 - min_obs_ratio``."""
    stats = panel.groupBy(*KEYS).agg(F.avg(F.col(x).isNull().cast("double")).alias("missing"))
    return stats.filter(F.col("missing") < F.lit(1.0) - min_obs_ratio)


def drop_empty_rows(panel: DataFrame, x: str = "x") -> DataFrame:
    """Without the dates on which no series has a value."""
    seen = panel.groupBy("panel_id", "ds").agg(F.count(x).alias("n")).filter("n > 0").select("panel_id", "ds")
    return panel.join(seen, ["panel_id", "ds"], "left_semi")


def drop_empty_series(panel: DataFrame, x: str = "x", complete: bool = False) -> DataFrame:
    """Without series that have no value at all, or (``complete``) any missing one."""
    stats = panel.groupBy(*KEYS).agg(F.count(x).alias("n"), F.count(F.lit(1)).alias("size"))
    kept = stats.filter("n = size") if complete else stats.filter("n > 0")
    return panel.join(kept.select(*KEYS), KEYS, "left_semi")


def restore_columns(forecast: DataFrame, meta: DataFrame, horizon: int) -> DataFrame:
    """Every series of ``meta`` at every step 1..horizon, NULL where there is no forecast; input order in ``pos``."""
    grid = meta.select(*KEYS, "pos", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return grid.join(forecast, [*KEYS, "h"], "left")
