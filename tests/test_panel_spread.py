"""A panel of many series is not dealt to one task, whatever its size."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import arma, impute, univariate
from tidepanel.panel import by_time, regularize
from tidepanel.sources import tables


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def most_in_a_task(df) -> tuple[int, int]:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes), sum(sizes)


def test_calendar_of_one_panel_is_spread(spark, no_broadcast):
    rows = [("p", f"s{i}", datetime.date(2000 + (i % 3), 1 + m, 1), float(m)) for i in range(200) for m in (0, 2, 5)]
    rows += [("q", None, datetime.date(2010, 1, 1), 1.0), ("q", "a", datetime.date(2010, 2, 1), None)]
    grid = regularize(spark.createDataFrame(rows, "panel_id string, series string, ds date, value double"))
    assert {(r.panel_id, r.n) for r in grid.groupBy("panel_id", "series").agg(F.count("*").alias("n")).collect()} == {("p", 30), ("q", 2)}
    assert {(r.panel_id, r.n_periods) for r in grid.select("panel_id", "n_periods").distinct().collect()} == {("p", 30), ("q", 2)}
    most, total = most_in_a_task(grid)
    assert total == 6004 and most < total / 3


def test_model_ready_is_spread_and_cuts_the_start_of_its_panel(spark, no_broadcast):
    # no series of p has a value before t = 5, and only one has it there; panel q has none at all
    rows = [("p", f"s{i}", t, None if t < 5 or (t == 5 and i) else float(t * (i + 1))) for i in range(200) for t in range(1, 21)]
    rows += [("q", "a", t, None) for t in range(1, 21)]
    panel = spark.createDataFrame(rows, "panel_id string, series string, t int, x double").withColumn("ds", F.expr("make_date(2000 + t, 1, 1)"))
    ready = impute.model_ready(panel, drop_leading=True)
    assert {tuple(r) for r in ready.groupBy("panel_id").agg(F.min("t"), F.max("t"), F.countDistinct("series")).collect()} == {("p", 5, 20, 200)}
    most, total = most_in_a_task(ready)
    assert total == 200 * 16 and most < total / 3


def test_dealt_series_stay_in_their_tasks_whatever_is_merged(spark):
    rows = [("p", f"s{i}", datetime.date(2000, 1 + m, 1), float(m)) for i in range(200) for m in (0, 2, 5)]
    cells = spark.createDataFrame(rows, "panel_id string, series string, ds date, value double")
    grid = regularize(cells, parts=40).withColumn("before", F.lag("value").over(by_time()))
    most, total = most_in_a_task(grid)
    assert total == 200 * 6 and most < total / 8
    assert grid.exceptAll(regularize(cells).withColumn("before", F.lag("value").over(by_time()))).isEmpty()


def test_fleet_windows_stay_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(univariate, "CELLS", 100)
    rows = [("p", f"s{i}", [float(k * i % 7) for k in range(40)]) for i in range(100)]
    packed = univariate.settled(spark.createDataFrame(rows, "panel_id string, series string, y array<double>"))
    lagged = arma.scaled_rows(arma.observations(packed), 2)
    most, total = most_in_a_task(lagged)
    assert total == 4000 and most < total / 8


def test_supplier_lines_are_dealt_by_cell_before_they_are_summed(spark, tmp_path):
    """No task that reads lines sums them: its sums would be all cells of its split."""
    rows = [(i % 50, datetime.datetime(1995, 1 + i % 7 // 2, 1 + i % 28), 100.0 + i, 0.05 * (i % 3)) for i in range(2000)]
    rows += [(None, datetime.datetime(1995, 2, 3), 7.0, 0.0), (3, datetime.datetime(1995, 2, 3), None, 0.0)]
    made = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double")
    for name, kind in (c.split() for c in tables.SCHEMAS["lineitem"].split(", ")):
        if name not in made.columns:
            made = made.withColumn(name, F.lit(None).cast(kind))
    made.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    panel = tables.supplier_month(spark, str(tmp_path))
    plan = panel._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "Scan parquet" in line]
    assert scans
    for i in scans:
        last = max(k for k in range(i) if "Exchange" in plan[k])
        assert "hashpartitioning(l_suppkey" in plan[last] and not any("Aggregate" in line for line in plan[last:i])
    sums = {}
    for key, day, price, discount in rows:
        if key is not None and day is not None and price is not None:
            at = str(key), day.date().replace(day=1)
            sums[at] = sums.get(at, 0) + round(price * 100) * (100 - round(discount * 100))
    got = {(r.series, r.ds): r.value for r in panel.filter("value is not null and series is not null").collect()}
    assert got == {at: v / 10000 for at, v in sums.items()}
