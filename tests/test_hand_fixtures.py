"""Small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluate, impute, inverse, transform, univariate

NAN = None
LEVELS = [100, 102, 101, None, 105, 110, 0, -4]
TRANSFORMED = {
    1: [100, 102, 101, NAN, 105, 110, 0, -4],
    2: [NAN, 2, -1, NAN, NAN, 5, -110, -4],
    3: [NAN, NAN, -3, NAN, NAN, NAN, -115, 106],
    4: [4.605170, 4.624973, 4.615121, NAN, 4.653960, 4.700480, NAN, NAN],
    5: [NAN, 0.019803, -0.009852, NAN, NAN, 0.046520, NAN, NAN],
    6: [NAN, NAN, -0.029655, NAN, NAN, NAN, NAN, NAN],
    7: [NAN, NAN, -0.029804, NAN, NAN, NAN, -1.047619, NAN],
}
STEPS = [0.01, -0.02, None, 0.03]
INVERTED = {
    1: [0.01, -0.02, NAN, 0.03],
    2: [102.01, 101.99, NAN, 102.02],
    3: [104.01, 106.00, NAN, 108.02],
    4: [1.010050, 0.980199, NAN, 1.030455],
    5: [103.025117, 100.985083, NAN, 104.060537],
    6: [105.085619, 106.120800, NAN, 110.429874],
    7: [105.060000, 106.110600, NAN, 110.355024],
}


def same(got, expected, tol=1e-5):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (g is None) == (e is None), (got, expected)
        assert g is None or g == pytest.approx(e, abs=tol), (got, expected)


def series_values(df, col, order="t"):
    out = {}
    for r in df.orderBy("series", order).collect():
        out.setdefault(r.series, []).append(r[col])
    return out


def test_codes(make_panel):
    panel = make_panel({str(c): LEVELS for c in TRANSFORMED}, {str(c): c for c in TRANSFORMED})
    got = series_values(transform.stationary(panel), "x")
    for code, expected in TRANSFORMED.items():
        same(got[str(code)], expected)


def test_unknown_code(make_panel):
    panel = make_panel({"a": [1, 2]}, {"a": 9})
    same(series_values(transform.stationary(panel), "x")["a"], [1, 2])
    with pytest.raises(Exception, match="unknown code"):
        transform.stationary(panel, unknown="error").collect()


def steps_table(spark, codes, anchors):
    rows = [("p", str(c), h, f, c) for c in codes for h, f in enumerate(STEPS, 1)]
    fc = spark.createDataFrame(rows, "panel_id string, series string, h int, f double, tcode int")
    last, prev = anchors
    a = spark.createDataFrame([("p", str(c), last, prev) for c in codes], "panel_id string, series string, last double, prev double")
    return fc, a


def test_inverse(spark):
    got = series_values(inverse.to_levels(*steps_table(spark, INVERTED, (102.0, 100.0))), "value", "h")
    for code, expected in INVERTED.items():
        same(got[str(code)], expected)


def test_inverse_on_arrays_is_the_same(spark):
    for anchors in [(102.0, 100.0), (0.0, 1.0), (5.0, None), (3.0, 0.0), (None, None)]:
        fc, a = steps_table(spark, INVERTED, anchors)
        windowed = series_values(inverse.to_levels(fc, a), "value", "h")
        packed = fc.groupBy("series", "tcode").agg(F.array_sort(F.collect_list(F.struct("h", "f"))).alias("p")).join(a, "series")
        path = inverse.level_path(F.transform("p", lambda s: s["f"]), F.col("last"), F.col("prev"), F.col("tcode"))
        for r in packed.select("series", path.alias("v")).collect():
            same(r.v, windowed[r.series], 1e-9)


def test_inverse_guards(spark):
    def levels(anchors, guard):
        fc, a = steps_table(spark, INVERTED, anchors)
        return series_values(inverse.to_levels(fc, a, guard=guard), "value", "h")

    bad = levels((-1.0, 2.0), "null")
    assert bad["5"] == [None] * 4 and bad["6"] == [None] * 4
    same(levels((-1.0, 2.0), "repeat")["5"], [-1, -1, None, -1])
    single = levels((5.0, None), "null")
    assert all(single[c] == [None] * 4 for c in "367")
    assert levels((5.0, 0.0), "null")["7"] == [None] * 4


def test_round_trip(make_panel):
    values = [10 + 3 * i + (i % 3) for i in range(12)]
    panel = make_panel({str(c): values for c in range(1, 8)}, {str(c): c for c in range(1, 8)})
    x = transform.stationary(panel)
    tail = x.filter("t > 8").withColumn("h", F.col("t") - 8).withColumnRenamed("x", "f").drop("value")
    got = series_values(inverse.to_levels(tail, inverse.anchors(panel.filter("t <= 8"))), "value", "h")
    for code in range(1, 8):
        same(got[str(code)], values[8:], 1e-9)


GAPPED = [1, None, None, None, None, None, 7, None, 9, None]


def test_gap_rules(make_panel):
    panel = make_panel({"a": GAPPED}).withColumn("ds", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t") - 1))
    same(series_values(impute.interpolate_first(panel), "value")["a"], [1, 2, 3, 4, None, None, 7, 8, 9, 9])
    same(series_values(impute.interpolate_short(panel), "value")["a"], [1, None, None, None, None, None, 7, 8, 9, None])
    kinds = [(r.t, r.kind) for r in impute.gap_cells(panel).orderBy("t").collect()]
    assert kinds == [(t, "interior") for t in (2, 3, 4, 5, 6, 8)] + [(10, "trailing")]


def test_correlograms(make_panel):
    panel = make_panel({"a": [2, 4, 3, 5, 4, 6]}).withColumnRenamed("value", "x")
    acf = univariate.autocorrelation(panel, max_lag=3)
    same([r.r for r in acf.orderBy("lag").collect()], [-0.1, 0.4, -0.4])
    same([r.r for r in univariate.partial_autocorrelations(acf).orderBy("lag").collect()][:2], [-0.1, 0.393939])


def test_constant_series_has_no_correlogram(make_panel):
    panel = make_panel({"a": [5] * 30}).withColumnRenamed("value", "x")
    assert {r.r for r in univariate.autocorrelation(panel).collect()} == {None}


def test_accuracy(spark):
    pairs = spark.createDataFrame([("p", "a", float(f), float(a)) for f, a in zip([10, 20, 30, 40], [12, 18, 0, 44])], "panel_id string, series string, forecast double, actual double")
    r = evaluate.accuracy(pairs).first()
    assert (r.me, r.mae, r.rmse, r.mape_pct, r.correlation, r.bias_direction) == (6.5, 9.5, 15.1987, 12.29, 0.5421, "over")


def test_edge_series(make_panel):
    n = 40
    wave = [50 + 10 * ((i * 7) % 11) for i in range(n)]
    columns = {
        "const": [5.0] * n, "short": [None] * (n - 19) + wave[:19], "allnull": [None] * n, "late": [None] * 10 + wave[10:],
        "ragged": wave[:-2] + [None, None], "holes": [None if i % 7 == 3 else v for i, v in enumerate(wave)],
    }
    panel = transform.stationary(make_panel(columns))
    fits = {r.series: r for r in univariate.fleet_levels(univariate.fit_ar(univariate.pack(panel), 1), "ar").collect()}
    assert set(fits) == set(columns)
    assert fits["short"].status == "short" and fits["short"].value is None
    assert fits["allnull"].value is None
    assert fits["ragged"].value is not None and fits["holes"].value is not None
    usable = {r.series for r in impute.model_ready(panel).select("series").distinct().collect()}
    assert "late" not in usable and "allnull" not in usable and "holes" in usable
    edge = {r.series: r.n_missing for r in impute.ragged_edge(panel).collect()}
    assert edge["ragged"] == 2
    anchors = {r.series: (r.last, r.prev) for r in inverse.anchors(panel).collect()}
    assert anchors["ragged"] == (wave[-3], wave[-4])
