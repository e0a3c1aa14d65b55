"""Panels built from the star-schema tables: raw rows are aggregated to one cell per series and period.

Money is summed in whole cents (integers), so a cell does not depend on the order in which rows meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.panel import panel_name, regularize


# Declared schemas: opening a table starts no job that reads file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Rows dealt to no more tasks than this are written straight to the file of each; beyond it (Spark's
#: ``spark.shuffle.sort.bypassMergeThreshold``) a task holds all rows of its split until it has sorted them.
DIRECT = 200


def _parts(raw: DataFrame) -> int:
    """Tasks that the series made of a raw table are dealt to: four for each split of the table, so that the share of
    one does not grow with it, and no fewer than the session's shuffle partitions. Planned only; no job runs."""
    least = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 4 * raw.rdd.getNumPartitions())


def _cents(c):
    return F.round(c * 100).cast("long")


def _month(c):
    return F.trunc(F.col(c).cast("date"), "MM")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value per nation.

    Orders are first summed per customer and month: a customer with a third of all orders shrinks to one
    row per month before anything is joined.
    """
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", _month("o_orderdate").alias("ds"))
        .agg(F.sum(_cents(F.col("o_totalprice"))).alias("cents"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "ds")
        .agg((F.sum("cents") / 100).alias("value"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(panel_name("nation_month", "n_name"), F.col("n_name").alias("series"), "ds", "value")
    )


def nation_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, group and position of each nation; the region is the group."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        panel_name("nation_month", "n_name"),
        F.col("n_name").alias("series"),
        (F.col("n_nationkey") % 7 + 1).cast("int").alias("tcode"),
        (F.col("r_regionkey") + 1).cast("int").alias("group_id"),
        F.col("r_name").alias("group_name"),
        (F.col("n_nationkey") + 1).cast("int").alias("pos"),
    )


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularize(nation_cells(spark, sf_dir), "month")


def region_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation series again, one panel per region: a small fleet of panels."""
    region = nation_meta(spark, sf_dir).select("series", "group_name")
    cells = nation_cells(spark, sf_dir).join(region, "series")
    return regularize(cells.select(F.col("group_name").alias("panel_id"), "series", "ds", "value"), "month")


def region_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_meta(spark, sf_dir).withColumn("panel_id", F.col("group_name"))


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per supplier; the number of series grows with the data.

    A split of the lines can have as many cells as lines, so lines are not summed where they are read: a sum there
    would hold all cells of a split. They are dealt by cell first, and a task holds the cells of its own part only.
    """
    units = _cents(F.col("l_extendedprice")) * (100 - _cents(F.col("l_discount")))
    lines = table(spark, sf_dir, "lineitem")
    parts = _parts(lines)
    dealt = lines.select("l_suppkey", _month("l_shipdate").alias("ds"), units.alias("units"))
    cells = (
        dealt.repartition(min(parts, DIRECT), "l_suppkey", "ds")
        .groupBy("l_suppkey", "ds")
        .agg((F.sum("units") / 10000).alias("value"))
        .select(panel_name("supplier_month", "l_suppkey"), F.col("l_suppkey").cast("string").alias("series"), "ds", "value")
    )
    return regularize(cells, "month", parts)


def supplier_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        panel_name("supplier_month", "s_suppkey"),
        F.col("s_suppkey").cast("string").alias("series"),
        (F.col("s_suppkey") % 7 + 1).cast("int").alias("tcode"),
    )


def flag_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped quantity per return flag and line status."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"), F.col("l_shipdate").cast("date").alias("ds"))
        .agg(F.sum("l_quantity").alias("value"))
        .select(panel_name("flag_day"), "series", "ds", "value")
    )
    return regularize(cells, "day")


def event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean event value per event type; has many gaps."""
    cells = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series"), F.date_trunc("HOUR", "ts").alias("ds"))
        .agg((F.sum(_cents(F.col("value"))) / F.count("value") / 100).alias("value"))
        .select(panel_name("event_hour"), "series", "ds", "value")
    )
    return regularize(cells, "hour")


def signed_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean account balance of the ordering customers per market segment; crosses zero."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("ds"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    cells = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "ds")
        .agg((F.sum(_cents(F.col("c_acctbal")) * F.col("n")) / F.sum("n") / 100).alias("value"))
        .select(panel_name("signed_day", "c_mktsegment"), F.col("c_mktsegment").alias("series"), "ds", "value")
    )
    return regularize(cells, "day")
