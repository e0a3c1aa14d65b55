"""Writing panels, forecasts, intervals and run records."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.dates import unpadded
from tidepanel.operators.evaluate import compare_to_history, growth_rates, month_over_month, summarize
from tidepanel.panel import KEYS

CODE_LABEL = "Transform:"


def to_wide(cells: DataFrame, names: list[str], suffix: str = "") -> DataFrame:
    """One row per date, one column per series; the column list is part of the output's schema."""
    wide = cells.groupBy("ds").pivot("series", names).agg(F.first("value"))
    wide = wide.withColumnsRenamed({n: n + suffix for n in names}) if suffix else wide
    return wide.withColumn("sasdate", unpadded(F.col("ds")))


def wide_rows(cells: DataFrame, names: list[str], suffix: str = "") -> DataFrame:
    """Wide output without code row: unpadded date first, then the series, in date order."""
    return to_wide(cells, names, suffix).orderBy("ds").select("sasdate", *[F.col(f"`{n}{suffix}`") for n in names])


def wide_rows_with_codes(cells: DataFrame, meta: DataFrame, names: list[str]) -> DataFrame:
    """Wide text output whose first row holds the codes; empty cells stay empty."""
    body = to_wide(cells, names).select(
        F.col("ds").alias("_order"), "sasdate", *[F.col(f"`{n}`").cast("string").alias(n) for n in names]
    )
    codes = meta.groupBy().pivot("series", names).agg(F.first("tcode"))
    head = codes.select(
        F.lit(None).cast("date").alias("_order"), F.lit(CODE_LABEL).alias("sasdate"),
        *[F.col(f"`{n}`").cast("string").alias(n) for n in names],
    )
    return head.unionByName(body).orderBy(F.asc_nulls_first("_order")).drop("_order")


def with_last_actual(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """The newest actual row of each panel put before its forecast."""
    newest = history.groupBy("panel_id").agg(F.max("ds").alias("ds"))
    last = history.join(newest, ["panel_id", "ds"]).select(*KEYS, "ds", "value")
    return last.join(forecast.select(*KEYS).distinct(), KEYS, "left_semi").unionByName(forecast.select(*KEYS, "ds", "value"))


def long_rows(forecast: DataFrame) -> DataFrame:
    return forecast.select(F.col("ds").alias("sasdate"), "series", F.col("value").alias("forecast_value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; sorted input is written in order, NULL as an empty cell."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def long_intervals(interval: DataFrame, horizon: int) -> DataFrame:
    """Mean, p5 and p95 as rows."""
    cells = interval.unpivot([*KEYS, "ds"], ["mean", "p5", "p95"], "measure", "value")
    return cells.withColumn("horizon", F.lit(horizon))


def write_intervals(interval: DataFrame, path: str, horizon: int) -> None:
    long_intervals(interval, horizon).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("horizon", "measure").parquet(path)


def write_samples(steps: DataFrame, path: str) -> None:
    """Simulated values of every step ``(series, sim, h, value)``, partitioned by step."""
    rows = steps.filter("draws is not null").select(*KEYS, "h", F.posexplode("draws").alias("sim", "value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("h").parquet(path)


def run_record(spark, run_id: int, **parameters) -> DataFrame:
    """One row with the parameters of a run."""
    row = {"run_id": run_id, **parameters}
    return spark.createDataFrame([tuple(row.values())], list(row)).withColumn("created_at", F.current_timestamp())


RUN_TABLES = ("runs", "draws", "forecasts")


def write_run(record: DataFrame, draws: DataFrame | None, forecasts: DataFrame, root: str, run_id: int) -> str:
    """Write a run to the tables ``runs``, ``draws`` and ``forecasts`` as one transaction; returns the attempt's name.

    Every attempt has files of its own, partitioned by run and attempt, which nobody reads until a manifest of the
    attempt is renamed into place as the last step. A job that ends before leaves no visible run. Writing a run again
    makes its newest attempt the visible one; other runs stay.
    """
    attempt = uuid.uuid4().hex
    tables = {"runs": record, "draws": draws, "forecasts": forecasts}
    for name, table in tables.items():
        if table is not None:
            own = table.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
            steps = ["horizon_step", "model_step"] if name == "draws" else []
            own.write.mode("append").partitionBy("run_id", "attempt", *steps).parquet(f"{root}/{name}")
    _commit(record.sparkSession, root, run_id, attempt)
    return attempt


def _manifest(spark, root: str, name: str = ""):
    """The file system and path of the manifest folder or of a file in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{name}".rstrip("/"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _commit(spark, root: str, run_id: int, attempt: str) -> None:
    """One manifest file per committed attempt, written aside and renamed."""
    files, aside = _manifest(spark, root, f".{attempt}")
    out = files.create(aside)
    out.writeBytes(json.dumps({"run_id": run_id, "attempt": attempt, "committed_at": time.time_ns()}) + "\n")
    out.close()
    if not files.rename(aside, _manifest(spark, root, f"{run_id}-{attempt}.json")[1]):
        raise OSError(f"attempt {attempt} of run {run_id} could not be committed")


def committed_runs(spark, root: str) -> DataFrame:
    """``(run_id, attempt)`` of the newest committed attempt of every run; none if nothing was committed."""
    files, folder = _manifest(spark, root)
    schema = "run_id int, attempt string, committed_at long"
    if not files.exists(folder):
        return spark.createDataFrame([], schema).drop("committed_at")
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{root}/manifest")
    return rows.groupBy("run_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def read_run_table(spark, root: str, name: str, run_id: int | None = None) -> DataFrame:
    """One of ``RUN_TABLES``, committed runs only, or the one named; run and attempt are partitions."""
    if name not in RUN_TABLES:
        raise ValueError(f"unknown table {name!r}")
    rows, runs = spark.read.parquet(f"{root}/{name}"), committed_runs(spark, root)
    if run_id is not None:
        rows, runs = rows.filter(F.col("run_id") == run_id), runs.filter(F.col("run_id") == run_id)
    return rows.join(runs, ["run_id", "attempt"], "left_semi").drop("attempt")


def read_draws(spark, root: str, run_id: int, horizon_step: int, model_step: str) -> DataFrame:
    """Draws of one step of one committed run; the keys are partitions, so nothing else is read."""
    draws = read_run_table(spark, root, "draws", run_id)
    return draws.filter((F.col("horizon_step") == horizon_step) & (F.col("model_step") == model_step))


def analysis_bundle(forecast: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a full analysis by name."""
    bundle = {
        "forecasts_raw": forecast,
        "summary_stats": summarize(forecast),
        "growth_rates": growth_rates(forecast),
        "month_over_month": month_over_month(forecast),
    }
    if history is not None:
        bundle["historical_comparison"] = compare_to_history(forecast, history)
    return bundle


def write_analysis(bundle: dict[str, DataFrame], root: str) -> None:
    for name, table in bundle.items():
        write_csv(table, f"{root}/{name}")
