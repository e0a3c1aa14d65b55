"""Reading wide panel files: one date column, one column per series, often a row of transform codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.dates import FORMATS_BASIC, parse_date_column
from tidepanel.functions.scalars import number, strip_suffix
from tidepanel.panel import KEYS, panel_name, unique_cells


def read_wide_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A wide CSV as text columns, header kept as it is."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding)


def is_code_row(date_text):
    return F.contains(F.lower(date_text), F.lit("transform"))


def _named(wide: DataFrame, panel_id: str) -> DataFrame:
    """The wide table with its first column as ``date_text`` and the panel's name."""
    first, *series = wide.columns
    rows = wide.select(F.col(f"`{first}`").alias("date_text"), *[F.col(f"`{n}`") for n in series])
    return rows.withColumn("panel_id", panel_name(panel_id, "date_text"))


def _melt(rows: DataFrame, series: list[str], *ids: str) -> DataFrame:
    return rows.unpivot([F.col(i) for i in ids], [F.col(f"`{n}`") for n in series], "series", "raw")


def split_wide(
    wide: DataFrame,
    panel_id: str,
    codes: str = "first",
    formats: Sequence[str] = FORMATS_BASIC,
    on_duplicate: str = "error",
) -> tuple[DataFrame, DataFrame]:
    """Split a wide text table into long cells ``(panel_id, series, ds, value)`` and series metadata.

    The code row is known by its label. ``codes`` says what to make of it: ``first`` turns an unreadable or
    absent code into 1, ``strict`` leaves it NULL and rejects a file without code row, ``auto`` accepts a file
    with or without one, ``none`` ignores it and sets every code to 1. Rows without a readable date are left out.
    Dates are read on the wide rows, before these are turned into cells.
    """
    if codes not in ("first", "strict", "auto", "none"):
        raise ValueError(f"unknown code rule {codes!r}")
    series = wide.columns[1:]
    rows = _named(wide, panel_id)
    labelled = is_code_row(F.col("date_text"))
    order = wide.sparkSession.createDataFrame(list(zip(series, range(1, len(series) + 1))), "series string, pos int")
    order = order.withColumn("panel_id", panel_name(panel_id))
    found = _melt(rows.filter(labelled), series, "panel_id")
    coded = found.groupBy("series").agg(F.max(number(F.col("raw"))).cast("int").alias("tcode"), F.lit(True).alias("_found"))
    code = {
        "none": F.lit(1),
        "strict": F.when(F.col("_found"), F.col("tcode")).otherwise(F.raise_error(F.lit("no code row in the file")).cast("int")),
    }.get(codes, F.coalesce("tcode", F.lit(1)))
    meta = order.join(coded, "series", "left").select(*KEYS, code.cast("int").alias("tcode"), "pos")
    dated = parse_date_column(rows.filter(~labelled), "date_text", formats, ["panel_id"]).filter("ds is not null")
    cells = _melt(dated, series, "panel_id", "ds").select(*KEYS, "ds", number(F.col("raw")).alias("value"))
    return unique_cells(cells, on_duplicate), meta


def read_wide(spark: SparkSession, path: str, panel_id: str, encoding: str = "UTF-8", **options) -> tuple[DataFrame, DataFrame]:
    return split_wide(read_wide_text(spark, path, encoding), panel_id, **options)


def forecast_rows(wide: DataFrame, panel_id: str, formats: Sequence[str] = FORMATS_BASIC) -> DataFrame:
    """Rows of a wide forecast table for display: code rows (label or colon in the date) skipped, suffix stripped."""
    text = F.lower("date_text")
    rows = _named(wide, panel_id).filter(~(F.contains(text, F.lit("transform")) | F.contains(text, F.lit(":"))))
    dated = parse_date_column(rows, "date_text", formats, ["panel_id"]).filter("ds is not null")
    cells = _melt(dated, wide.columns[1:], "panel_id", "ds")
    return cells.select("panel_id", strip_suffix(F.col("series")).alias("series"), "ds", number(F.col("raw")).alias("value"))


def read_intervals(spark: SparkSession, root: str, horizon: int, panel_id: str) -> DataFrame:
    """Interval set of one horizon, written by ``sinks.write_intervals``; an absent horizon gives no rows."""
    long = spark.read.schema(
        "panel_id string, series string, ds date, value double, horizon int, measure string"
    ).option("ignoreMissingFiles", "true").parquet(root)
    picked = long.filter((F.col("horizon") == horizon) & (F.col("panel_id") == panel_id))
    return picked.groupBy(*KEYS, "ds").pivot("measure", ["mean", "p5", "p95"]).agg(F.first("value"))


#: What the bytes 0x80 to 0x9F stand for in windows-1252; five of them stand for nothing.
_CONTROLS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}


def read_appendix(spark: SparkSession, path: str, panel_id: str, encoding: str | None = None) -> DataFrame:
    """Series to group map from CSV files with columns ``fred`` and ``group``.

    Without ``encoding`` a file is UTF-8 if its bytes are valid, and windows-1252 otherwise; files of both kinds may lie
    in one folder. Only the list of files, and which of them are valid, comes to the driver.
    """
    wanted = lambda df: df.select("fred", "group")
    if encoding:
        raw = wanted(spark.read.csv(path, header=True, encoding=encoding))
    else:
        kinds = spark.read.format("binaryFile").load(path).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid")).collect()
        tables = []
        for valid in (True, False):
            files = [r["path"] for r in kinds if r["valid"] == valid]
            if files:
                rows = wanted(spark.read.csv(files, header=True, encoding="UTF-8" if valid else "ISO-8859-1"))
                # ISO-8859-1 has control characters where windows-1252 has signs and quotes
                tables.append(rows if valid else rows.select(*[F.translate(c, "".join(_CONTROLS), "".join(_CONTROLS.values())).alias(c) for c in rows.columns]))
        if not tables:
            return spark.createDataFrame([], "panel_id string, series string, group_id int")
        raw = reduce(DataFrame.unionByName, tables)
    return raw.select(
        panel_name(panel_id, "fred"), F.col("fred").alias("series"), F.col("group").try_cast("int").alias("group_id")
    )


def read_series_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blank lines and ``#`` comments are skipped."""
    name = F.trim("value")
    return spark.read.text(path).select(name.alias("series")).filter((F.col("series") != "") & ~F.col("series").startswith("#"))
