"""Reading and writing files."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.dates import FORMATS_WIDE
from tidepanel.operators import select
from tidepanel.panel import unique_cells
from tidepanel.sinks import tables as sinks
from tidepanel.sources import wide

CSV = "sasdate,A,S&P 500,bad\nTransform:,5,2,x\n1/1/2000,1.5,10,\n2/1/2000,2.5,oops,3\n,9,9,9\n"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text(CSV)
    return str(path)


def test_read_wide(spark, csv):
    cells, meta = wide.read_wide(spark, csv, "p")
    assert {(r.series, r.tcode, r.pos) for r in meta.collect()} == {("A", 5, 1), ("S&P 500", 2, 2), ("bad", 1, 3)}
    got = {(r.series, str(r.ds)): r.value for r in cells.collect()}
    assert got == {
        ("A", "2000-01-01"): 1.5, ("A", "2000-02-01"): 2.5, ("S&P 500", "2000-01-01"): 10.0, ("S&P 500", "2000-02-01"): None,
        ("bad", "2000-01-01"): None, ("bad", "2000-02-01"): 3.0,
    }


def test_code_rules(spark, csv, tmp_path):
    strict = wide.read_wide(spark, csv, "p", codes="strict")[1]
    assert {r.series: r.tcode for r in strict.collect()}["bad"] is None
    assert {r.tcode for r in wide.read_wide(spark, csv, "p", codes="none")[1].collect()} == {1}
    plain = tmp_path / "plain.csv"
    plain.write_text("d,A\n2000-01-01,1\n2000-02-01,2\n")
    cells, meta = wide.read_wide(spark, str(plain), "p", codes="auto", formats=FORMATS_WIDE)
    assert meta.first().tcode == 1 and cells.count() == 2
    with pytest.raises(Exception, match="no code row"):
        wide.read_wide(spark, str(plain), "p", codes="strict")[1].collect()


def test_one_format_per_file(spark, tmp_path):
    """3/4/2000 is day first once another date of the file only fits that way."""
    path = tmp_path / "d.csv"
    path.write_text("d,A\n03/04/2000,1\n25/04/2000,2\n")
    cells, _ = wide.read_wide(spark, str(path), "p", codes="auto", formats=FORMATS_WIDE)
    assert {str(r.ds) for r in cells.collect()} == {"2000-04-03", "2000-04-25"}


def test_duplicates(spark):
    rows = [("p", "a", datetime.date(2000, 1, 1), 1.0), ("p", "a", datetime.date(2000, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "panel_id string, series string, ds date, value double")
    with pytest.raises(Exception, match="duplicate cell"):
        unique_cells(df).collect()
    assert unique_cells(df, "mean").first().value == 2.0


def test_wide_csv_round_trip(spark, make_panel, tmp_path):
    panel = make_panel({"a": [1.0, None, 3.0], "b": [4.0, 5.0, 6.0]}, {"a": 2, "b": 5})
    meta = panel.select("panel_id", "series", "tcode").distinct()
    out = str(tmp_path / "out")
    sinks.write_csv(sinks.wide_rows_with_codes(panel, meta, ["a", "b"]).coalesce(1), out)
    lines = spark.read.text(out).collect()
    assert [r.value for r in lines][:3] == ["sasdate,a,b", "Transform:,2,5", "1/1/2000,1.0,4.0"]
    assert lines[3].value == "2/1/2000,,5.0"
    cells, codes = wide.read_wide(spark, out, "p")
    assert {(r.series, str(r.ds)[:7], r.value) for r in cells.collect()} == {
        ("a", "2000-01", 1.0), ("a", "2000-02", None), ("a", "2000-03", 3.0), ("b", "2000-01", 4.0), ("b", "2000-02", 5.0), ("b", "2000-03", 6.0),
    }
    assert {r.series: r.tcode for r in codes.collect()} == {"a": 2, "b": 5}


def test_appendix_list_and_aliases(spark, tmp_path):
    path = tmp_path / "appendix.csv"
    path.write_bytes("fred,group,description\nA,1,caf\xe9\nB,x,\n".encode("cp1252"))
    assert {(r.series, r.group_id) for r in wide.read_appendix(spark, str(path), "p", "iso-8859-1").collect()} == {("A", 1), ("B", None)}
    names = tmp_path / "names.txt"
    names.write_text("# comment\n\n A \nB\n")
    assert {r.series for r in wide.read_series_list(spark, str(names)).collect()} == {"A", "B"}
    table = spark.createDataFrame([("S_P500",), ("A",)], "series string")
    assert {r.series for r in select.resolve_alias(table).collect()} == {"S&P 500", "A"}
    assert {r.group_id for r in select.group_table(spark).collect()} == set(range(1, 9))


def test_intervals_and_runs(spark, make_panel, tmp_path):
    panel = make_panel({"a": [1.0, 2.0]})
    band = panel.select("panel_id", "series", "ds", F.col("value").alias("mean"), (F.col("value") - 1).alias("p5"), (F.col("value") + 1).alias("p95"))
    root = str(tmp_path / "intervals")
    sinks.write_intervals(band, root, 12)
    back = wide.read_intervals(spark, root, 12, "p").orderBy("ds").collect()
    assert [(r["mean"], r.p5, r.p95) for r in back] == [(1.0, 0.0, 2.0), (2.0, 1.0, 3.0)]
    assert wide.read_intervals(spark, root, 24, "p").count() == 0
    draws = spark.createDataFrame([("p", 0, 0, "Psi", "a", 1.5, 0, "factor")], "panel_id string, chain int, draw int, param string, series string, value double, horizon_step int, model_step string")
    runs = str(tmp_path / "runs")
    for run_id in (1, 2):
        sinks.write_run(sinks.run_record(spark, run_id, method="efficient", n_factors=5), draws, band, runs, run_id)
    got = sinks.read_draws(spark, runs, 2, 0, "factor")
    assert got.count() == 1 and got.first().value == 1.5
    assert sinks.read_draws(spark, runs, 2, 1, "factor").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert sinks.read_run_table(spark, runs, "forecasts").filter("run_id = 1").count() == 2


def test_a_run_is_visible_as_a_whole_or_not_at_all(spark, make_panel, tmp_path):
    panel, root = make_panel({"a": [1.0, 2.0]}), str(tmp_path / "runs")
    table = lambda add: panel.select("panel_id", "series", "ds", (F.col("value") + add).alias("mean"))
    values = lambda: sorted((r.run_id, r["mean"]) for r in sinks.read_run_table(spark, root, "forecasts").collect())
    record = lambda i: sinks.run_record(spark, i, method="efficient")
    broken = table(0).withColumn("mean", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(record(1), None, broken, root, 1)
    assert sinks.committed_runs(spark, root).count() == 0 and sinks.read_run_table(spark, root, "runs").count() == 0
    sinks.write_run(record(1), None, table(0), root, 1)
    sinks.write_run(record(2), None, table(10), root, 2)
    assert values() == [(1, 1.0), (1, 2.0), (2, 11.0), (2, 12.0)]
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(record(2), None, broken, root, 2)
    assert values() == [(1, 1.0), (1, 2.0), (2, 11.0), (2, 12.0)]
    sinks.write_run(record(2), None, table(20), root, 2)
    assert values() == [(1, 1.0), (1, 2.0), (2, 21.0), (2, 22.0)] and sinks.read_run_table(spark, root, "runs").count() == 2
    with pytest.raises(ValueError):
        sinks.read_run_table(spark, root, "other")


def test_appendix_of_either_encoding(spark, tmp_path):
    folder = tmp_path / "appendix"
    folder.mkdir()
    (folder / "a.csv").write_bytes("fred,group\nMOODY\u2019S,1\ncaf\u00e9,2\n".encode("cp1252"))
    (folder / "b.csv").write_bytes("description,group,fred\nx,3,\u20acB\n,y,C\n".encode())
    got = {(r.series, r.group_id) for r in wide.read_appendix(spark, str(folder), "p").collect()}
    assert got == {("MOODY\u2019S", 1), ("caf\u00e9", 2), ("\u20acB", 3), ("C", None)}


def test_analysis_bundle(spark, make_panel, tmp_path):
    panel = make_panel({"a": [float(i + 1) for i in range(30)], "b": [float(30 - i) for i in range(30)]})
    bundle = sinks.analysis_bundle(panel.filter("t > 24"), panel.filter("t <= 24"))
    assert set(bundle) == {"forecasts_raw", "summary_stats", "growth_rates", "month_over_month", "historical_comparison"}
    sinks.write_analysis(bundle, str(tmp_path / "bundle"))
    assert spark.read.csv(str(tmp_path / "bundle/summary_stats"), header=True).count() == 2


def test_bad_selections(spark, make_panel):
    meta = spark.createDataFrame([("p", "a", 1, 1, "Prices"), ("p", "b", 2, 2, "Housing")], "panel_id string, series string, pos int, group_id int, group_name string")
    assert [r.series for r in select.by_positions(meta, "2-1").orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        select.by_positions(meta, "0")
    with pytest.raises(Exception, match="beyond"):
        select.by_positions(meta, "3").collect()
    with pytest.raises(Exception, match="unknown series"):
        select.by_names(meta, ["zz"]).collect()
    assert [r.series for r in select.unknown_names(meta, ["a", "zz"]).collect()] == ["zz"]
    assert [r.series for r in select.by_groups(meta, "hous").collect()] == ["b"]
    with pytest.raises(Exception, match="cannot spare"):
        select.split_holdout(make_panel({"a": [1.0, 2.0]}), 2).collect()
