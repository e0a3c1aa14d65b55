"""Lining up forecasts with history and actuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import month_key
from tidepanel.functions.scalars import strip_suffix
from tidepanel.panel import KEYS


def common_series(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Names present on both sides once a value suffix is stripped."""
    left = forecast.select(F.col("series").alias("forecast_series")).distinct()
    right = history.select("series").distinct()
    return left.join(right, strip_suffix(F.col("forecast_series")) == F.col("series"))


def match_actuals(forecast: DataFrame, actual: DataFrame, on: str = "ds") -> DataFrame:
    """Pairs of forecast and actual per series and date (``ds``) or month (``month``); empty pairs are left out."""
    f = forecast.filter("value is not null").withColumn("series", strip_suffix(F.col("series")))
    a = actual.filter("value is not null").select(*KEYS, "ds", F.col("value").alias("actual"))
    f = f.withColumnRenamed("value", "forecast")
    if on == "ds":
        return f.join(a, [*KEYS, "ds"])
    if on != "month":
        raise ValueError(f"unknown key {on!r}")
    a = a.select(*KEYS, month_key(F.col("ds")).alias("month"), "actual")
    return f.withColumn("month", month_key(F.col("ds"))).join(a, [*KEYS, "month"])


def history_then_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed history followed by the forecast after each series' last observation, labelled by kind."""
    seen = history.filter("value is not null")
    last = seen.groupBy(*KEYS).agg(F.max("ds").alias("_last"))
    ahead = (
        forecast.filter("value is not null")
        .withColumn("series", strip_suffix(F.col("series")))
        .join(last, KEYS)
        .filter(F.col("ds") > F.col("_last"))
    )
    return seen.select(*KEYS, "ds", "value", F.lit("historical").alias("kind")).unionByName(
        ahead.select(*KEYS, "ds", "value", F.lit("forecast").alias("kind"))
    )


def chart_axis(actual: DataFrame, forecasts: DataFrame, interval: DataFrame, models: dict[str, str], months_back: int = 24) -> DataFrame:
    """One row per series and month: actual of the months before the first forecast, each model's forecast, interval.

    ``forecasts`` carry ``model``; ``models`` names the column of each model that is shown. ``interval`` carries
    ``mean, p5, p95``. The pieces are stacked and folded by one aggregation instead of a chain of outer joins.
    """
    empty = F.lit(None).cast("double")
    shown = forecasts.filter(F.col("value").isNotNull() & F.col("model").isin(*models))
    point = shown.select(*KEYS, "ds", *[F.when(F.col("model") == m, F.col("value")).alias(c) for m, c in models.items()])
    band = interval.filter("mean is not null").select(*KEYS, "ds", "mean", "p5", "p95")
    starts = point.select(*KEYS, "ds").unionByName(band.select(*KEYS, "ds")).groupBy(*KEYS).agg(F.min("ds").alias("_from"))
    recent = (
        actual.filter("value is not null")
        .join(starts, KEYS, "left")
        .filter(F.col("_from").isNull() | (F.col("ds") >= F.add_months("_from", -months_back)))
        .select(*KEYS, "ds", F.col("value").alias("actual"))
    )
    columns = ["actual", *models.values(), "mean", "p5", "p95"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            *KEYS, month_key(F.col("ds")).alias("month"),
            *[F.col(c) if c in df.columns else empty.alias(c) for c in columns],
        )

    stacked = shaped(recent).unionByName(shaped(point)).unionByName(shaped(band))
    return stacked.groupBy(*KEYS, "month").agg(*[F.max(c).alias(c) for c in columns])
