"""Predictive summaries of simulated values held as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.panel import KEYS, by_time


ACCURACY = 10_000  # of the quantile sketch: its ranks are off by at most n / ACCURACY
SMALL = 20_000  # draws of a series up to which all of them are ordered, once for all shares
ALL = "all"


def _quantiles(draws: DataFrame, shares: dict[str, tuple[float, Column]], by: tuple[str, ...]) -> DataFrame:
    """Exact interpolated order statistics; ``shares`` gives name -> (share, 1-based position as expression of ``n``).

    A mergeable sketch first brackets every wanted rank between two values that are three times its error apart.
    Values below a bracket are only counted and those inside it are ordered, equal ones merged before. So a
    series with a third of all draws is spread over tasks and never sorted as a whole, whatever its distribution.
    """
    group = [*KEYS, *by]
    seen = draws.filter("value is not null")
    margin = 3 / ACCURACY
    probes = [min(max(p + side * margin, 0.0), 1.0) for p, _ in shares.values() for side in (-1, 1)]
    sketch = F.percentile_approx("value", F.array(*[F.lit(p) for p in probes]), ACCURACY)
    ends = draws.groupBy(*group).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), sketch.alias("_q")
    )
    values = seen.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("_m")).join(ends.drop("mean", "sd"), group)

    def piece(name: str, below: Column, above: Column) -> Column:
        return F.struct(F.lit(name).alias("_name"), below.alias("_below"), (~below & ~above).alias("_inside"))

    def bracket(i: int, name: str, p: float) -> Column:
        below = F.lit(p > margin) & (F.col("value") < F.col("_q")[2 * i])
        return piece(name, below, F.lit(p < 1 - margin) & (F.col("value") > F.col("_q")[2 * i + 1]))

    brackets = F.array(*[bracket(i, name, p) for i, (name, (p, _)) in enumerate(shares.items())])
    whole = F.array(piece(ALL, F.lit(False), F.lit(False)))
    pieces = F.when(F.col("n") <= SMALL, whole).otherwise(F.filter(brackets, lambda s: s["_below"] | s["_inside"]))
    sorted_out = values.withColumn("_p", F.explode(pieces)).select(*group, "n", "value", "_m", "_p.*")
    before = sorted_out.filter("_below").groupBy(*group, "_name").agg(F.sum("_m").alias("_before"))
    upto = Window.partitionBy(*group, "_name").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sorted_out.filter("_inside").join(before, [*group, "_name"], "left")
    near = near.withColumn("_upto", F.coalesce("_before", F.lit(0)) + F.sum("_m").over(upto))

    def at(name: str, rank: Column) -> Column:
        hit = F.col("_name").isin(name, ALL) & (F.col("_upto") - F.col("_m") < rank) & (rank <= F.col("_upto"))
        return F.max(F.when(hit, F.col("value")))

    columns = []
    for name, (_, pos) in shares.items():
        lo, hi = at(name, F.floor(pos)), at(name, F.ceil(pos))
        columns.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    points = near.groupBy(*group).agg(*columns)
    missed = F.raise_error(F.lit("a bracket of the sketch misses its rank"))
    checked = [F.when((F.col("n") > 0) & F.col(c).isNull(), missed).otherwise(F.col(c)).alias(c) for c in shares]
    return ends.drop("_q").join(points, group, "left").select(*group, "n", "mean", "sd", *checked)


def interval(draws: DataFrame, *by: str) -> DataFrame:
    """Mean, exact 5% and 95% points (linear between order statistics) and deviation per series, ignoring NULL."""
    last = F.col("n") - 1
    return _quantiles(draws, {"p5": (0.05, last * 0.05 + 1), "p95": (0.95, last * 0.95 + 1)}, by)


def order_statistics(draws: DataFrame, shares: list[float], *by: str) -> DataFrame:
    """Percentiles with mid-point plotting positions: position ``n p + 1/2`` between order statistics, clipped to the ends.

    Share 0.05 is column ``p5``, share 0.024 is ``p2_4``.
    """
    n = F.col("n")
    place = {p: F.least(F.greatest(n * F.lit(p) + 0.5, F.lit(1.0)), n.cast("double")) for p in shares}
    names = {p: f"p{p * 100:.10g}".replace(".", "_") for p in shares}
    return _quantiles(draws, {names[p]: (p, pos) for p, pos in place.items()}, by)


def recent_slope(panel: DataFrame, value: str = "value", lookback: int = 12) -> DataFrame:
    """Slope over the newest ``lookback`` periods times their number; needs more than three values."""
    newest = panel.filter(F.col("t") > F.col("n_periods") - lookback)
    stats = newest.groupBy(*KEYS).agg(F.count(value).alias("n"), F.regr_slope(value, "t").alias("slope"))
    return stats.filter("n > 3").select(*KEYS, (F.col("slope") * F.col("n")).alias("trend"))


def blended_variance(panel: DataFrame, value: str = "value", lookback: int = 12) -> DataFrame:
    """Half the variance of the series, half that of its newest changes; the latter bounded by 0.1 and 10 times the blend."""
    rows = panel.withColumns({
        "_d": F.col(value) - F.lag(value).over(by_time()), "_s2": F.var_samp(value).over(Window.partitionBy(*KEYS)),
    }).filter(F.col("t") > F.col("n_periods") - lookback + 1)
    stats = rows.groupBy(*KEYS).agg(F.max("_s2").alias("_s2"), F.var_samp("_d").alias("recent"))
    base = 0.5 * F.col("_s2") + 0.5 * F.col("recent")
    stats = stats.withColumn("base", base)
    return stats.select(*KEYS, "base", F.least(F.greatest("recent", 0.1 * F.col("base")), 10 * F.col("base")).alias("vol"))
