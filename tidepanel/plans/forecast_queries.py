"""Queries over univariate models, alignment and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import add_suffix, rounded
from tidepanel.operators import evaluate, joins, select, univariate
from tidepanel.operators.transform import stationary
from tidepanel.panel import KEYS, with_meta
from tidepanel.plans import arma_sql as A
from tidepanel.plans.catalog import register
from tidepanel.plans.panel_queries import coded_nation, split_nation
from tidepanel.plans.panels_sql import HORIZON, anchors_sql, levels_sql, query, transform_sql
from tidepanel.sources import tables as T


def forecast_and_truth(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(AR(1) forecast of the held-out year, history, actuals) of ``nation_month``."""
    history, actual = split_nation(spark, d)
    return univariate.ar1_forecast(history, HORIZON).select(*KEYS, "h", "ds", "value"), history, actual


def naive_forecast_table(history: DataFrame) -> DataFrame:
    return univariate.naive(history, HORIZON).withColumnRenamed("f", "value")


def supplier_x(spark, d) -> DataFrame:
    return stationary(with_meta(T.supplier_month(spark, d), T.supplier_meta(spark, d)))


# ---------------------------------------------------------------- univariate models

SMX = ("smx", transform_sql("sm"))
ACF_ROWS = (
    SMX,
    ("obs", "SELECT series, t, x, x - avg(x) OVER (PARTITION BY series) AS e, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM smx WHERE x IS NOT NULL"),
    ("led", "SELECT series, n, e, " + ", ".join(f"lead(e, {k}) OVER (PARTITION BY series ORDER BY t) AS e{k}" for k in range(1, 13)) + " FROM obs"),
    ("rho", "SELECT series, n, " + ", ".join(f"sum(e * e{k}) / nullif(sum(e * e), 0) AS r{k}" for k in range(1, 13)) + " FROM led GROUP BY series, n"),
    ("acfr", " UNION ALL ".join(f"SELECT series, n, CAST({k} AS INT) AS lag, r{k} AS r FROM rho" for k in range(1, 13))),
)


def _pacf_chain() -> list[tuple[str, str]]:
    """Durbin-Levinson unrolled, one common table per lag."""
    out = [("dl1", "SELECT *, r1 AS a1, r1 AS p1_1 FROM rho")]
    for k in range(2, 13):
        num = f"r{k} - (" + " + ".join(f"p{k-1}_{j} * r{k-j}" for j in range(1, k)) + ")"
        den = "1 - (" + " + ".join(f"p{k-1}_{j} * r{j}" for j in range(1, k)) + ")"
        out.append((f"dla{k}", f"SELECT *, ({num}) / ({den}) AS a{k} FROM dl{k-1}"))
        terms = ", ".join(f"p{k-1}_{j} - a{k} * p{k-1}_{k-j} AS p{k}_{j}" for j in range(1, k))
        out.append((f"dl{k}", f"SELECT *, {terms}, a{k} AS p{k}_{k} FROM dla{k}"))
    return out


PACF_ROWS = (*ACF_ROWS, *_pacf_chain(), ("pacfr", " UNION ALL ".join(f"SELECT series, n, CAST({k} AS INT) AS lag, a{k} AS r FROM dl12" for k in range(1, 13))))
ORDER = """SELECT series, n, CAST(CASE WHEN n < 22 THEN 1 ELSE coalesce(greatest(min(CASE WHEN abs(r) < 1.96 / sqrt(n) THEN lag END) - 1, 1), 12) END AS INT) AS "order" FROM {src} GROUP BY series, n"""


@register("acf12", query("SELECT series, n, lag, round(r, 8) + 0.0 AS r FROM acfr", *ACF_ROWS))
def acf12(spark, d):
    out = univariate.autocorrelation(supplier_x(spark, d))
    return out.select("series", "n", "lag", rounded(F.col("r"), 8).alias("r"))


@register("pacf12", query("SELECT series, n, lag, round(r, 7) + 0.0 AS r FROM pacfr", *PACF_ROWS))
def pacf12(spark, d):
    out = univariate.partial_autocorrelations(univariate.autocorrelation(supplier_x(spark, d)))
    return out.select("series", "n", "lag", rounded(F.col("r"), 7).alias("r"))


@register("ma_order", query(ORDER.format(src="acfr"), *ACF_ROWS))
def ma_order(spark, d):
    return univariate.choose_order(univariate.autocorrelation(supplier_x(spark, d))).drop("panel_id")


@register("ar_order", query(ORDER.format(src="pacfr"), *PACF_ROWS))
def ar_order(spark, d):
    acf = univariate.autocorrelation(supplier_x(spark, d))
    return univariate.choose_order(univariate.partial_autocorrelations(acf)).drop("panel_id")


@register("ar1_forecast", query("SELECT series, h, ds, round(value, 1) + 0.0 AS value FROM fc"))
def ar1_forecast(spark, d):
    return forecast_and_truth(spark, d)[0].select("series", "h", "ds", rounded(F.col("value"), 1).alias("value"))


@register(
    "naive_forecast",
    query(f"""SELECT 'last' AS rule, series, h, round(value, 2) AS value FROM naive_fc UNION ALL
        SELECT 'mean', series, h, round(value, 2) FROM (SELECT series, avg(value) AS value FROM hist GROUP BY series), (SELECT CAST(unnest(range(1, {HORIZON} + 1)) AS INT) AS h)"""),
)
def naive_forecast(spark, d):
    history, _ = split_nation(spark, d)
    tables = [univariate.naive(history, HORIZON, rule).withColumn("rule", F.lit(rule)) for rule in ("last", "mean")]
    return reduce(DataFrame.unionByName, tables).select("rule", "series", "h", rounded(F.col("f"), 2).alias("value"))


AR2 = (
    SMX,
    ("obs", "SELECT *, lag(x) OVER w AS b1, lag(x, 2) OVER w AS b2 FROM smx WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t)"),
    ("mom", """SELECT series, tcode, var_pop(b1) AS s11, var_pop(b2) AS s22, covar_pop(b1, b2) AS s12, covar_pop(b1, x) AS s1, covar_pop(b2, x) AS s2,
        avg(x) AS my, avg(b1) AS m1, avg(b2) AS m2 FROM obs WHERE b2 IS NOT NULL GROUP BY series, tcode"""),
    ("phi", "SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS p1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS p2 FROM mom"),
    ("tail", "SELECT series, count(*) AS n, arg_max(x, t) AS y1, arg_max(b1, t) AS y2 FROM obs GROUP BY series HAVING count(*) >= 20"),
    ("st1", "SELECT phi.*, y1, y2, my - p1 * m1 - p2 * m2 AS c FROM phi JOIN tail USING (series)"),
    ("st2", "SELECT *, c + p1 * y1 + p2 * y2 AS f1 FROM st1"),
    ("st3", "SELECT *, c + p1 * f1 + p2 * y1 AS f2 FROM st2"),
    ("st4", "SELECT *, c + p1 * f2 + p2 * f1 AS f3 FROM st3"),
    ("arf", "SELECT series, tcode, CAST(1 AS INT) AS h, f1 AS f FROM st4 UNION ALL SELECT series, tcode, 2, f2 FROM st4 UNION ALL SELECT series, tcode, 3, f3 FROM st4"),
    ("sa", anchors_sql("sm")),
)


@register("ar2_fleet", query("SELECT series, h, round(value, 1) + 0.0 AS value FROM (" + levels_sql("arf", "sa") + ")", *AR2))
def ar2_fleet(spark, d):
    fitted = univariate.fit_ar(univariate.pack(supplier_x(spark, d)), 3, lags=2)
    return univariate.fleet_levels(fitted, "ar").select("series", "h", rounded(F.col("value"), 1).alias("value"))


def _fleet(forecast: DataFrame) -> DataFrame:
    return forecast.select("series", "h", "ds", F.format_string("%.6e", "value").alias("value"))


def _fleet_sql(*tables: tuple[str, str]) -> str:
    dated = f"SELECT f.series, f.h, CAST(l.ds + to_months(f.h) AS DATE) AS ds, printf('%.6e', f.value) AS value FROM ({levels_sql('flf', 'sa')}) f, (SELECT max(ds) AS ds FROM sm) l"
    return query(dated, SMX, *tables, ("sa", anchors_sql("sm")))


@register("ar_fleet", _fleet_sql(*A.ar("smx", "fl", HORIZON)))
def ar_fleet(spark, d):
    fitted = univariate.fit_ar(univariate.pack(supplier_x(spark, d)), HORIZON)
    return _fleet(univariate.fleet_levels(fitted, "ar"))


@register("ma_fleet", _fleet_sql(*A.ma("smx", "fl", HORIZON)))
def ma_fleet(spark, d):
    fitted = univariate.fit_ma(univariate.pack(supplier_x(spark, d)), HORIZON)
    return _fleet(univariate.fleet_levels(fitted, "ma"))


@register("arima_grid", query("SELECT series, CAST(p AS INT) AS p, CAST(q AS INT) AS q, round(aic, 6) + 0.0 AS aic FROM flmodel", SMX, *A.arima("smx", "fl", HORIZON)))
def arima_grid(spark, d):
    return univariate.arima_grid(univariate.pack(supplier_x(spark, d)), HORIZON).select("series", "p", "q", rounded(F.col("aic"), 6).alias("aic"))


def _backtest_sql() -> str:
    models = {"ar": A.ar, "ma": A.ma, "arima": A.arima}
    tables = [t for name, make in models.items() for t in make("histx", name, HORIZON)]
    levels = " UNION ALL ".join(f"SELECT '{name}' AS model, series, h, value FROM ({levels_sql(name + 'f', 'hist_anchor')})" for name in models)
    pairs = """SELECT model, b.series, b.value AS f, act.value AS a FROM backlevels b CROSS JOIN (SELECT max(ds) AS last FROM hist)
        JOIN act ON act.series = b.series AND act.ds = CAST(last + to_months(b.h) AS DATE) WHERE b.value IS NOT NULL AND act.value IS NOT NULL"""
    return query(
        f"""SELECT model, series, count(*) AS n_obs, printf('%.5e', avg(f - a)) AS me, printf('%.5e', avg(abs(f - a))) AS mae, printf('%.5e', sqrt(avg((f - a) * (f - a)))) AS rmse,
        printf('%.7e', round(avg(abs((f - a) / nullif(a, 0)) * 100), 2)) AS mape_pct, round({CORR}, 4) + 0.0 AS correlation, CASE WHEN avg(f - a) > 0 THEN 'over' ELSE 'under' END AS bias_direction
        FROM backpairs GROUP BY model, series""",
        *tables, ("backlevels", levels), ("backpairs", pairs),
    )


def fleet_backtest(spark, d):
    """AR, MA and ARIMA forecasts of the held-out year and their errors."""
    history, actual = split_nation(spark, d)
    forecasts = univariate.fleet(univariate.pack(stationary(history)), HORIZON)
    pairs = joins.match_actuals(forecasts.select(*KEYS, "model", "ds", "value"), actual)
    out = evaluate.accuracy(pairs, "model").drop("panel_id")
    return out.withColumns({c: F.format_string("%.7e" if c == "mape_pct" else "%.5e", c) for c in ("me", "mae", "rmse", "mape_pct")})


@register(
    "fleet_status",
    query("SELECT status, count(*) AS n_series FROM (SELECT series, CASE WHEN count(x) >= 20 THEN 'ok' ELSE 'short' END AS status FROM smx GROUP BY series) GROUP BY status", SMX),
)
def fleet_status(spark, d):
    fitted = univariate.fit_ar(univariate.pack(supplier_x(spark, d)), 1)
    return evaluate.status_counts(univariate.fleet_levels(fitted, "ar"))


# ---------------------------------------------------------------- alignment


@register("common_series", query("SELECT DISTINCT series || '_value' AS forecast_series, series FROM act WHERE series IN (SELECT series FROM hist GROUP BY series HAVING count(value) = count(*))"))
def common_series(spark, d):
    history, actual = split_nation(spark, d)
    forecast = actual.withColumn("series", add_suffix(F.col("series")))
    return joins.common_series(forecast, select.drop_empty_series(history, "value", complete=True))


@register("history_plus_forecast", query("""SELECT series, ds, round(value, 1) + 0.0 AS value, 'historical' AS kind FROM hist WHERE value IS NOT NULL
    UNION ALL SELECT fc.series, fc.ds, round(fc.value, 1) + 0.0, 'forecast' FROM fc JOIN (SELECT series, max(ds) AS last FROM hist WHERE value IS NOT NULL GROUP BY series) l
    ON l.series = fc.series AND fc.ds > last WHERE fc.value IS NOT NULL"""))
def history_plus_forecast(spark, d):
    fc, history, _ = forecast_and_truth(spark, d)
    return joins.history_then_forecast(history, fc).select("series", "ds", rounded(F.col("value"), 1).alias("value"), "kind")


BAND = ("band", "SELECT series, ds, value AS mean, value * 0.9 AS p5, value * 1.1 AS p95 FROM naive_fc")


def _band(history: DataFrame) -> DataFrame:
    table = naive_forecast_table(history)
    return table.select(*KEYS, "ds", F.col("value").alias("mean"), (F.col("value") * 0.9).alias("p5"), (F.col("value") * 1.1).alias("p95"))


def _chart_sql(models: dict[str, str]) -> str:
    names = ["actual", *models.values(), "mean", "p5", "p95"]
    row = lambda **own: ", ".join(f"{own.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in names)
    points = " ".join(f"UNION ALL SELECT series, strftime(ds, '%Y-%m') AS month, {row(**{c: 'value'})} FROM {t} WHERE value IS NOT NULL" for t, c in models.items())
    starts = " UNION ALL ".join(f"SELECT series, ds FROM {t} WHERE value IS NOT NULL" for t in models)
    return f"""SELECT series, month, {", ".join(f"round(max({c}), 1) + 0.0 AS {c}" for c in names)} FROM (
        SELECT nm.series, strftime(ds, '%Y-%m') AS month, {row(actual="value")}
        FROM nm JOIN (SELECT series, min(ds) AS s FROM ({starts} UNION ALL SELECT series, ds FROM band) GROUP BY series) f ON f.series = nm.series
        WHERE value IS NOT NULL AND ds >= s - INTERVAL 24 MONTH
        {points}
        UNION ALL SELECT series, strftime(ds, '%Y-%m'), {row(mean="mean", p5="p5", p95="p95")} FROM band) GROUP BY series, month"""


def _chart(spark, d, models: dict[str, str]):
    fc, history, _ = forecast_and_truth(spark, d)
    both = fc.select(*KEYS, "ds", "value", F.lit("fc").alias("model")).unionByName(
        naive_forecast_table(history).select(*KEYS, "ds", "value", F.lit("naive_fc").alias("model"))
    )
    out = joins.chart_axis(coded_nation(spark, d), both, _band(history), models)
    return out.select("series", "month", *[rounded(F.col(c), 1).alias(c) for c in ("actual", *models.values(), "mean", "p5", "p95")])


@register("chart_axis", query(_chart_sql({"fc": "forecast"}), BAND))
def chart_axis(spark, d):
    return _chart(spark, d, {"fc": "forecast"})


@register("chart_axis_models", query(_chart_sql({"fc": "ar1", "naive_fc": "naive"}), BAND))
def chart_axis_models(spark, d):
    """Two models beside each other."""
    return _chart(spark, d, {"fc": "ar1", "naive_fc": "naive"})


@register("interval_rows", query("SELECT series, ds, measure, round(value, 1) + 0.0 AS value, 12 AS horizon FROM band UNPIVOT (value FOR measure IN (mean, p5, p95))", BAND))
def interval_rows(spark, d):
    from tidepanel.sinks.tables import long_intervals

    out = long_intervals(_band(split_nation(spark, d)[0]), HORIZON)
    return out.select("series", "ds", "measure", rounded(F.col("value"), 1).alias("value"), "horizon")


# ---------------------------------------------------------------- evaluation

PCT = "({b} - {a}) / nullif(abs({a}), 0) * 100"
TREND = "CASE WHEN {p} IS NULL THEN 'N/A' WHEN {p} > 1 THEN '↑ Up' WHEN {p} < -1 THEN '↓ Down' ELSE '→ Flat' END"
SUMMARY = (
    ("sums", """SELECT series, min(ds) AS start_date, max(ds) AS end_date, count(*) AS n_periods, arg_min(value, ds) AS a, arg_max(value, ds) AS b,
        min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_samp(value) AS sd FROM fc WHERE value IS NOT NULL GROUP BY series"""),
    ("summary", f"""SELECT series, start_date, end_date, n_periods, round(a, 1) + 0.0 AS first_value, round(b, 1) + 0.0 AS last_value, round(lo, 1) + 0.0 AS min, round(hi, 1) + 0.0 AS max,
        round(mu, 1) + 0.0 AS mean, round(sd, 1) + 0.0 AS std, round(b - a, 1) + 0.0 AS total_change, round({PCT.format(a='a', b='b')}, 2) + 0.0 AS pct_change, {TREND.format(p=PCT.format(a='a', b='b'))} AS trend FROM sums"""),
)


@register("forecast_summary", query("SELECT * FROM summary", *SUMMARY))
def forecast_summary(spark, d):
    fc, _, _ = forecast_and_truth(spark, d)
    out = evaluate.summarize(fc).drop("panel_id")
    return out.withColumns({c: rounded(F.col(c), 1) for c in ("first_value", "last_value", "min", "max", "mean", "std", "total_change")})


GROWTH = """SELECT series, round(m, 4) + 0.0 AS avg_monthly_growth_pct, round(m * 12, 4) + 0.0 AS avg_annual_growth_pct, round(s, 4) + 0.0 AS volatility_monthly_pct,
    round(s * sqrt(12), 4) + 0.0 AS volatility_annual_pct, round(lo, 4) + 0.0 AS min_monthly_pct, round(hi, 4) + 0.0 AS max_monthly_pct,
    CASE WHEN mixed THEN 'pct_change' ELSE 'log_return' END AS method FROM (
    SELECT series, avg(r) AS m, stddev_samp(r) AS s, min(r) AS lo, max(r) AS hi, bool_or(mixed) AS mixed FROM (
        SELECT series, mixed, CASE WHEN mixed THEN value / nullif(b, 0) - 1 ELSE CASE WHEN value > 0 THEN ln(value) END - CASE WHEN b > 0 THEN ln(b) END END * 100 AS r FROM (
            SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ds) AS b, bool_or(value <= 0) OVER (PARTITION BY series) AS mixed FROM {src} WHERE value IS NOT NULL))
    WHERE r IS NOT NULL GROUP BY series)"""


@register("growth_rates", query(GROWTH.format(src="sm")))
def growth_rates(spark, d):
    return evaluate.growth_rates(T.supplier_month(spark, d)).drop("panel_id")


@register("growth_rates_signed", query(GROWTH.format(src="sd")))
def growth_rates_signed(spark, d):
    return evaluate.growth_rates(T.signed_day(spark, d)).drop("panel_id")


@register(
    "mom_table",
    query("SELECT series, ds, round(value, 1) + 0.0 AS value, round(value - lag(value) OVER w, 1) + 0.0 AS chg, round((value / nullif(lag(value) OVER w, 0) - 1) * 100, 5) + 0.0 AS pct FROM fc WINDOW w AS (PARTITION BY series ORDER BY ds)"),
)
def mom_table(spark, d):
    out = evaluate.month_over_month(forecast_and_truth(spark, d)[0])
    return out.select("series", "ds", rounded(F.col("value"), 1).alias("value"), rounded(F.col("chg"), 1).alias("chg"), rounded(F.col("pct"), 5).alias("pct"))


HISTORY = """SELECT series, round(hl, 2) + 0.0 AS hist_last, round(ff, 2) + 0.0 AS fcst_first, round({jump}, 2) + 0.0 AS jump_pct, round(hm, 2) + 0.0 AS hist_mean, round(fm, 2) + 0.0 AS fcst_mean,
    round({shift}, 2) + 0.0 AS mean_shift_pct, round(hs, 2) + 0.0 AS hist_std, round(fs, 2) + 0.0 AS fcst_std,
    printf('[%.1f, %.1f]', hlo, hhi) AS hist_range, printf('[%.1f, %.1f]', flo, fhi) AS fcst_range,
    CASE WHEN CASE WHEN hlo >= 0 THEN flo >= hlo * 0.9 AND fhi <= hhi * 1.1 ELSE flo >= hlo - (hhi - hlo) * 0.1 AND fhi <= hhi + (hhi - hlo) * 0.1 END THEN 'Yes' ELSE 'No' END AS in_hist_range
    FROM (SELECT series, arg_max(value, ds) AS hl, avg(value) AS hm, stddev_samp(value) AS hs, min(value) AS hlo, max(value) AS hhi FROM (
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM {h} WHERE value IS NOT NULL) WHERE rn <= 24 GROUP BY series)
    JOIN (SELECT series, arg_min(value, ds) AS ff, avg(value) AS fm, stddev_samp(value) AS fs, min(value) AS flo, max(value) AS fhi FROM {f} WHERE value IS NOT NULL GROUP BY series) USING (series)"""
SHIFTS = {"jump": PCT.format(a="hl", b="ff"), "shift": PCT.format(a="hm", b="fm")}


@register("history_comparison", query(HISTORY.format(h="hist", f="fc", **SHIFTS)))
def history_comparison(spark, d):
    fc, history, _ = forecast_and_truth(spark, d)
    return evaluate.compare_to_history(fc, history).drop("panel_id")


@register(
    "history_comparison_signed",
    query(HISTORY.format(h="past", f="late", **SHIFTS), ("past", "SELECT * FROM sd WHERE ds < DATE '2000-01-01'"), ("late", "SELECT * FROM sd WHERE ds >= DATE '2000-01-01'")),
)
def history_comparison_signed(spark, d):
    panel = T.signed_day(spark, d)
    late = F.col("ds") >= F.lit("2000-01-01").cast("date")
    return evaluate.compare_to_history(panel.filter(late), panel.filter(~late)).drop("panel_id")


CORR = """CASE WHEN count(*) > 1 AND var_pop(f) > 0 AND var_pop(a) > 0 THEN covar_pop(f, a) / (sqrt(var_pop(f)) * sqrt(var_pop(a))) END"""
PAIRS = ("pairs", """SELECT fc.series, fc.value AS f, act.value AS a FROM fc JOIN act ON act.series = fc.series AND act.ds = fc.ds
    WHERE fc.value IS NOT NULL AND act.value IS NOT NULL""")


register("fleet_backtest", _backtest_sql())(fleet_backtest)


@register(
    "accuracy",
    query(
        f"""SELECT series, count(*) AS n_obs, round(avg(f - a), 1) + 0.0 AS me, round(avg(abs(f - a)), 1) + 0.0 AS mae, round(sqrt(avg((f - a) * (f - a))), 1) + 0.0 AS rmse,
        round(avg(abs((f - a) / nullif(a, 0)) * 100), 2) + 0.0 AS mape_pct, round({CORR}, 4) + 0.0 AS correlation,
        CASE WHEN avg(f - a) > 0 THEN 'over' ELSE 'under' END AS bias_direction FROM pairs GROUP BY series""",
        PAIRS,
    ),
)
def accuracy(spark, d):
    fc, _, actual = forecast_and_truth(spark, d)
    out = evaluate.accuracy(joins.match_actuals(fc, actual)).drop("panel_id")
    return out.withColumns({c: rounded(F.col(c), 1) for c in ("me", "mae", "rmse")})


METRICS = ", ".join(
    f"round(sqrt(avg((f - a) * (f - a)) FILTER (model = '{m}')), 1) + 0.0 AS {m}_rmse, round(avg(abs((f - a) / nullif(a, 0)) * 100) FILTER (model = '{m}'), 4) + 0.0 AS {m}_mape, "
    f"round(max(cr) FILTER (model = '{m}'), 4) + 0.0 AS {m}_correlation"
    for m in ("ar1", "naive")
)


@register(
    "metrics_table",
    query(
        f"SELECT series, {METRICS} FROM (SELECT series, model, f, a, cr FROM both_ JOIN (SELECT series, model, {CORR} AS cr FROM both_ GROUP BY series, model) USING (series, model)) GROUP BY series",
        ("both_", """SELECT x.series, x.model, x.value AS f, act.value AS a FROM (SELECT *, 'ar1' AS model FROM fc UNION ALL SELECT *, 'naive' FROM naive_fc) x
            JOIN act ON act.series = x.series AND strftime(act.ds, '%Y-%m') = strftime(x.ds, '%Y-%m') WHERE x.value IS NOT NULL AND act.value IS NOT NULL"""),
    ),
)
def metrics_table(spark, d):
    fc, history, actual = forecast_and_truth(spark, d)
    both = fc.withColumn("model", F.lit("ar1")).unionByName(naive_forecast_table(history).withColumn("model", F.lit("naive")))
    pairs = joins.match_actuals(both, actual, on="month")
    out = evaluate.metrics_table(pairs, ["ar1", "naive"], sort_by="ar1_rmse")
    return out.select("series", *[
        rounded(F.col(f"{m}_{c}"), digits).alias(f"{m}_{c}") for m in ("ar1", "naive") for c, digits in (("rmse", 1), ("mape", 4), ("correlation", 4))
    ])


@register(
    "quick_look",
    query(f"SELECT series, pos, round(a, 1) + 0.0 AS first_value, round(b, 1) + 0.0 AS last_value, round({PCT.format(a='a', b='b')}, 2) + 0.0 AS pct_change FROM (SELECT series, arg_min(value, ds) AS a, arg_max(value, ds) AS b FROM fc GROUP BY series) JOIN nmeta USING (series) WHERE pos <= 10"),
)
def quick_look(spark, d):
    out = evaluate.quick_look(forecast_and_truth(spark, d)[0], T.nation_meta(spark, d))
    return out.drop("panel_id").withColumns({c: rounded(F.col(c), 1) for c in ("first_value", "last_value")})


@register(
    "series_detail",
    query(
        f"""SELECT s.series, s.n_periods, s.first_value, s.last_value, s.min, s.max, s.mean, s.std, s.total_change, s.pct_change,
        gm AS growth_mean, gs AS growth_std, hm AS hist_mean, hl AS hist_last FROM summary s
        JOIN (SELECT series, round(avg(g), 4) + 0.0 AS gm, round(stddev_samp(g), 4) + 0.0 AS gs FROM (SELECT series, (value / nullif(lag(value) OVER (PARTITION BY series ORDER BY ds), 0) - 1) * 100 AS g FROM fc) GROUP BY series) USING (series)
        JOIN (SELECT series, round(avg(value), 2) AS hm, round(arg_max(value, ds), 2) AS hl FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM hist WHERE value IS NOT NULL) WHERE rn <= 24 GROUP BY series) USING (series)
        WHERE s.series = 'NATION_7'""",
        *SUMMARY,
    ),
)
def series_detail(spark, d):
    fc, history, _ = forecast_and_truth(spark, d)
    out = evaluate.series_detail(fc, history, "NATION_7")
    big = ("first_value", "last_value", "min", "max", "mean", "std", "total_change")
    return out.withColumns({c: rounded(F.col(c), 1) for c in big}).select(
        "series", "n_periods", *big, "pct_change", "growth_mean", "growth_std", "hist_mean", "hist_last"
    )


@register(
    "kpi_report",
    query("""SELECT max((pct_change, series))[2] AS largest_rise, max(pct_change) AS rise_pct, min((pct_change, series))[2] AS largest_fall, min(pct_change) AS fall_pct,
        count(*) FILTER (pct_change > 1) AS n_up, count(*) FILTER (pct_change < -1) AS n_down, count(*) FILTER (pct_change BETWEEN -1 AND 1) AS n_flat
        FROM summary WHERE pct_change IS NOT NULL""", *SUMMARY),
)
def kpi_report(spark, d):
    return evaluate.kpi_report(evaluate.summarize(forecast_and_truth(spark, d)[0])).drop("panel_id")


@register(
    "plot_rows",
    query("""SELECT series, ds, round(value, 1) + 0.0 AS value, 'historical' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM hist WHERE value IS NOT NULL) WHERE rn <= 60
        UNION ALL SELECT series, ds, round(value, 1) + 0.0, 'forecast' FROM fc WHERE value IS NOT NULL"""),
)
def plot_rows(spark, d):
    fc, history, _ = forecast_and_truth(spark, d)
    return evaluate.plot_rows(history, fc).select("series", "ds", rounded(F.col("value"), 1).alias("value"), "kind")
