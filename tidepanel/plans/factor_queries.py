"""Queries over factor models, rolling windows and predictive draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import rounded
from tidepanel.operators import evaluate, factor, joins, predictive
from tidepanel.operators.transform import standardize, stationary
from tidepanel.panel import KEYS, panel_name, with_meta
from tidepanel.plans.catalog import register
from tidepanel.plans import factor_sql as S
from tidepanel.plans.forecast_queries import CORR, PAIRS
from tidepanel.plans.panel_queries import GAP3, coded_nation, split_nation
from tidepanel.plans.panel_queries import READY as READY_SQL
from tidepanel.plans.panels_sql import HORIZON, anchors_sql, levels_sql, query, transform_sql
from tidepanel.sources import tables as T

SPEC = factor.FactorSpec(k=2, min_obs=60, horizon=HORIZON)
ROLLING = factor.FactorSpec(k=2, min_obs=24, horizon=1, window=36)
READY = factor.FactorSpec(k=3, prepare="ready", dynamics="ar1", horizon=HORIZON)


def coded_supplier(spark, d) -> DataFrame:
    return with_meta(T.supplier_month(spark, d), T.supplier_meta(spark, d))


ZC = ("zc", """SELECT series, t, coalesce((x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 0 THEN stddev_samp(x) OVER w ELSE 1 END, 0) AS z
    FROM nmx WINDOW w AS (PARTITION BY series) QUALIFY count(x) OVER w >= 60""")


@register("gram_matrix", query("SELECT CAST(a.t - 1 AS INT) AS i, CAST(b.t - 1 AS INT) AS j, round(sum(a.z * b.z), 6) + 0.0 AS g FROM zc a JOIN zc b ON a.series = b.series AND a.t <= b.t GROUP BY ALL HAVING sum(a.z * b.z) <> 0", ZC))
def gram_matrix(spark, d):
    cells = factor.cross_moments(factor.pack_levels(coded_nation(spark, d)), SPEC)
    return cells.filter("j >= 0").select("i", "j", rounded(F.col("g"), 6).alias("g"))


GIVEN = (
    ("nz", "SELECT n.series, n.t, group_id AS k, (x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 0 THEN stddev_samp(x) OVER w ELSE 1 END AS z FROM nmx n JOIN nmeta m ON m.series = n.series WINDOW w AS (PARTITION BY n.series)"),
    ("fac", "SELECT k, t, avg(z) AS f FROM nz WHERE z IS NOT NULL GROUP BY k, t"),
    ("lod", "SELECT nz.series, fac.k, avg(z * f) AS l FROM nz JOIN fac ON fac.t = nz.t WHERE z IS NOT NULL GROUP BY nz.series, fac.k"),
    ("com", "SELECT series, t, sum(f * l) AS common FROM lod JOIN fac USING (k) GROUP BY series, t"),
)


def _given(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised panel, group-mean factors and the series' loadings on them."""
    z = standardize(stationary(coded_nation(spark, d))).join(T.nation_meta(spark, d).select(*KEYS, F.col("group_id").alias("k")), KEYS)
    z = z.filter("z is not null")
    factors = z.groupBy("panel_id", "k", "t").agg(F.avg("z").alias("f"))
    loadings = z.drop("k").join(factors, ["panel_id", "t"]).groupBy(*KEYS, "k").agg(F.avg(F.col("z") * F.col("f")).alias("l"))
    return z, factors, loadings


@register(
    "factor_ar1",
    query("""SELECT k, n, round(c, 8) + 0.0 AS c, round(greatest(least(b, 0.99), -0.99), 8) + 0.0 AS phi, round(greatest(sqrt(greatest(syy - sxy * sxy / sxx, 0) / n), 0.01), 8) AS sigma, round(f_last, 8) + 0.0 AS f_last
        FROM (SELECT k, count(*) AS n, regr_intercept(f, b) AS c, regr_slope(f, b) AS b, regr_syy(f, b) AS syy, regr_sxy(f, b) AS sxy, regr_sxx(f, b) AS sxx, arg_max(f, t) AS f_last
        FROM (SELECT *, lag(f) OVER (PARTITION BY k ORDER BY t) AS b FROM fac) WHERE b IS NOT NULL GROUP BY k)""", *GIVEN),
)
def factor_ar1(spark, d):
    out = factor.factor_ar1(_given(spark, d)[1])
    return out.select("k", "n", *[rounded(F.col(c), 8).alias(c) for c in ("c", "phi", "sigma", "f_last")])


@register("loading_map", query("SELECT series, t, round(common, 8) + 0.0 AS common FROM com", *GIVEN))
def loading_map(spark, d):
    _, factors, loadings = _given(spark, d)
    return factor.map_factors(factors, loadings, "t").select("series", "t", rounded(F.col("common"), 8).alias("common"))


@register("idiosyncratic_sd", query("SELECT series, round(greatest(stddev_pop(z - common), 0.01), 8) AS psi FROM nz JOIN com USING (series, t) WHERE z IS NOT NULL GROUP BY series", *GIVEN))
def idiosyncratic_sd(spark, d):
    z, factors, loadings = _given(spark, d)
    return factor.idiosyncratic_sd(z, factor.map_factors(factors, loadings, "t")).select("series", rounded(F.col("psi"), 8).alias("psi"))


@register(
    "rolling_windows",
    query("""SELECT series, CAST(o AS INT) AS origin, CAST(count(value) AS INT) AS n, round(avg(value), 6) AS mu, round(stddev_samp(value), 6) AS sd
        FROM fd JOIN (SELECT unnest(range(0, (SELECT max(t) FROM fd) - 120)) AS o) ON t > o AND t <= o + 120 GROUP BY series, o"""),
)
def rolling_windows(spark, d):
    out = factor.window_moments(T.flag_day(spark, d), 120, 1, "value")
    return out.select("series", "origin", "n", rounded(F.col("mu"), 6).alias("mu"), rounded(F.col("sd"), 6).alias("sd"))


NATION_Z = ("zn", S.standardised("nmx", 60))
SUPPLIER_Z = (("smx", transform_sql("sm")), ("zs", S.standardised("smx", 60)))


@register("pca_scores", query("SELECT t, k, round(f, 6) + 0.0 AS f FROM scores", NATION_Z, *S.scores("zn", 2)))
def pca_scores(spark, d):
    models = factor.window_models(factor.pack_levels(coded_nation(spark, d)), SPEC)
    return factor.factor_scores(models).select("t", "k", rounded(F.col("f"), 6).alias("f"))


@register("pca_loadings", query("SELECT series, k, round(l, 6) + 0.0 AS l FROM load", *SUPPLIER_Z, *S.scores("zs", 2), S.loadings("zs")))
def pca_loadings(spark, d):
    packed = factor.pack_levels(coded_supplier(spark, d))
    return factor.panel_loadings(packed, SPEC, factor.window_models(packed, SPEC)).select("series", "k", rounded(F.col("l"), 6).alias("l"))


def _explained_sql(panel: str, z: str, p: str) -> str:
    return f"""SELECT '{panel}' AS panel_id, CAST(0 AS INT) AS origin, CAST(2 AS INT) AS k, (SELECT count(DISTINCT series) FROM {z}) AS n_series, (SELECT count(DISTINCT t) FROM {z}) AS n_rows,
        round(100 * sum(DISTINCT l) / (SELECT sum(z * z) FROM {z}), 7) AS explained_pct, 'ok' AS status FROM {p}scores"""


@register(
    "variance_explained",
    query(_explained_sql("supplier_month", "zs", "s") + " UNION ALL " + _explained_sql("nation_month", "zn", "n"), *SUPPLIER_Z, NATION_Z, *S.scores("zs", 2, "s"), *S.scores("zn", 2, "n")),
)
def variance_explained(spark, d):
    packed = factor.pack_levels(coded_supplier(spark, d)).unionByName(factor.pack_levels(coded_nation(spark, d)))
    return factor.explained_variance(packed, SPEC).withColumn("explained_pct", F.round("explained_pct", 7))


HOURLY = factor.FactorSpec(k=1, min_obs=200, horizon=24, freq="hour")


@register(
    "pca_hours",
    query(
        "SELECT t, CAST(1 AS INT) AS k, round(f * (SELECT sign(arg_max(f, abs(f))) FROM fh), 6) + 0.0 AS f FROM fh",
        # five series and 720 hours: the vectors of the series first, periods and series change places
        ("ehx", "SELECT *, 1 AS tcode, value AS x FROM eh"), ("zh", S.standardised("ehx", 200)), ("zt", "SELECT t AS series, series AS t, z FROM zh"), *S.scores("zt", 1),
        ("fh", "SELECT zh.t, sum(z * f / sqrt(l)) AS f FROM zh JOIN scores ON scores.t = zh.series GROUP BY zh.t"),
    ),
)
def pca_hours(spark, d):
    """First factor of the hourly panel, whose calendar has more periods than the panel has series."""
    models = factor.window_models(factor.pack_levels(T.event_hour(spark, d).withColumn("tcode", F.lit(1))), HOURLY)
    return factor.factor_scores(models).select("t", "k", rounded(F.col("f"), 6).alias("f"))


def _levels_of_fx(source: str) -> str:
    return f"SELECT f.series, f.h, CAST(l.ds + to_months(f.h) AS DATE) AS ds, f.value FROM ({levels_sql('fx', source + '_anchor')}) f, (SELECT max(ds) AS ds FROM {source}) l"


SUPPLIERS = (("sm_anchor", anchors_sql("sm")), ("sall", "SELECT DISTINCT series, tcode FROM sm"))
NATIONS = (("nm_anchor", anchors_sql("nm")), ("nall", "SELECT DISTINCT series, tcode FROM nm"))


def _forecast(forecast: DataFrame) -> DataFrame:
    return forecast.select("series", "h", "ds", F.format_string("%.6e", "value").alias("value"))


FORECAST = "SELECT series, h, ds, printf('%.6e', value) AS value FROM lev"


@register("pca_var_forecast", query(FORECAST, *SUPPLIER_Z, *S.scores("zs", 2), *S.var1_path(HORIZON), *SUPPLIERS, *S.forecasts("zs", "sall", HORIZON), ("lev", _levels_of_fx("sm"))))
def pca_var_forecast(spark, d):
    return _forecast(factor.forecast_panel(factor.pack_levels(coded_supplier(spark, d)), SPEC))


@register(
    "pca_var_backtest",
    query(
        f"""SELECT series, count(*) AS n_obs, printf('%.6e', avg(f - a)) AS me, printf('%.6e', avg(abs(f - a))) AS mae, printf('%.6e', sqrt(avg((f - a) * (f - a)))) AS rmse,
        printf('%.7e', round(avg(abs((f - a) / nullif(a, 0)) * 100), 2)) AS mape_pct, round({CORR}, 4) + 0.0 AS correlation, CASE WHEN avg(f - a) > 0 THEN 'over' ELSE 'under' END AS bias_direction FROM pairs GROUP BY series""",
        ("zb", S.standardised("histx", 60)), *S.scores("zb", 2), *S.var1_path(HORIZON), ("hall", "SELECT DISTINCT series, tcode FROM hist"), *S.forecasts("zb", "hall", HORIZON),
        ("fcb", _levels_of_fx("hist")), ("pairs", PAIRS[1].replace("fc", "fcb")),
    ),
)
def pca_var_backtest(spark, d):
    history, actual = split_nation(spark, d)
    forecast = factor.forecast_panel(factor.pack_levels(history), SPEC)
    out = evaluate.accuracy(joins.match_actuals(forecast.select(*KEYS, "ds", "value"), actual)).drop("panel_id")
    return out.withColumns({c: F.format_string("%.7e" if c == "mape_pct" else "%.6e", c) for c in ("me", "mae", "rmse", "mape_pct")})


@register("rolling_h1")
def rolling_h1(spark, d):
    return factor.rolling_forecast(factor.pack_levels(coded_nation(spark, d)), ROLLING)


@register("rolling_h12")
def rolling_h12(spark, d):
    spec = factor.FactorSpec(k=2, min_obs=24, horizon=HORIZON, window=36)
    return factor.rolling_forecast(factor.pack_levels(coded_nation(spark, d)), spec)


READY_Z = (
    *READY_SQL,
    ("filled", f"SELECT series, t, {GAP3} AS v FROM near"),
    ("carried", """SELECT series, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x, CAST(CAST(series AS INT) % 7 + 1 AS INT) AS tcode FROM filled"""),
    ("zr", S.standardised("carried", 1)),
)


@register("svd_factor", query(FORECAST, *READY_Z, *S.scores("zr", 3), *S.ar1_path(HORIZON), *SUPPLIERS, *S.forecasts("zr", "sall", HORIZON), ("lev", _levels_of_fx("sm"))))
def svd_factor(spark, d):
    """SVD factor model with AR(1) factors on the model-ready supplier panel, mean forecast."""
    return _forecast(factor.forecast_panel(factor.pack_levels(coded_supplier(spark, d)), READY))


@register("ssm_fallback", query(FORECAST, ("zf", S.standardised("nmx", 1)), *S.scores("zf", 3), *S.decay_path(HORIZON, 0.9), *NATIONS, *S.forecasts("zf", "nall", HORIZON), ("lev", _levels_of_fx("nm"))))
def ssm_fallback(spark, d):
    spec = factor.FactorSpec(k=3, min_obs=1, dynamics="decay", horizon=HORIZON)
    return _forecast(factor.forecast_panel(factor.pack_levels(coded_nation(spark, d)), spec))


HORIZONS = [1, 2, 4, 6, 12, 24, 60]


@register(
    "horizon_sweep",
    query("""SELECT hz AS horizon, count(*) AS n_rows, count(DISTINCT series) AS n_series,
        CAST(min(last + to_months(h)) AS DATE) AS first_ds, CAST(max(last + to_months(h)) AS DATE) AS last_ds
        FROM (SELECT DISTINCT series FROM nm), (SELECT max(ds) AS last FROM nm), (SELECT CAST(unnest(range(1, 61)) AS INT) AS h),
        (SELECT CAST(unnest([1, 2, 4, 6, 12, 24, 60]) AS INT) AS hz) WHERE h <= hz GROUP BY hz"""),
)
def horizon_sweep(spark, d):
    spec = factor.FactorSpec(k=3, order=3, min_obs=60, horizon=max(HORIZONS))
    sweep = factor.horizon_sweep(factor.pack_levels(coded_nation(spark, d)), spec, HORIZONS)
    return factor.manifest(sweep).drop("panel_id")


FULL = factor.FactorSpec(k=25, min_obs=60, horizon=1)


@register("pca_reconstruction", query("SELECT series, t, round(z, 6) + 0.0 AS z FROM zc", ZC))
def pca_reconstruction(spark, d):
    """With as many factors as series, scores times loadings give the standardised panel back."""
    packed = factor.pack_levels(coded_nation(spark, d))
    models = factor.window_models(packed, FULL)
    common = factor.map_factors(factor.factor_scores(models), factor.panel_loadings(packed, FULL, models), "t")
    return common.select("series", "t", rounded(F.col("common"), 6).alias("z"))


PERSIST_WINDOW = 36


@register(
    "rolling_persistence",
    query(
        """SELECT series, CAST(o AS INT) AS origin, CAST(last_ds + to_months(1) AS DATE) AS ds, round(CASE tcode WHEN 2 THEN last + f WHEN 3 THEN 2 * last - prev + f WHEN 4 THEN exp(f)
        WHEN 5 THEN last * exp(f) WHEN 6 THEN last * exp(ln(last) - ln(prev) + f) WHEN 7 THEN last * (last / prev + f) ELSE f END, -2) + 0.0 AS value FROM fin""",
        ("win", f"""SELECT n.*, o, row_number() OVER (PARTITION BY series, o ORDER BY CASE WHEN value IS NULL THEN 1 ELSE 0 END, t DESC) AS rn, t - o AS i
            FROM nmx n JOIN (SELECT unnest(range(0, (SELECT max(t) FROM nm) - {PERSIST_WINDOW})) AS o) ON t > o AND t <= o + {PERSIST_WINDOW}"""),
        ("cutx", "SELECT *, CASE WHEN i <= CASE WHEN tcode IN (3, 6, 7) THEN 2 WHEN tcode IN (2, 5) THEN 1 ELSE 0 END THEN NULL ELSE x END AS wx FROM win"),
        ("fin", """SELECT series, o, tcode, max(ds) AS last_ds, max(CASE WHEN rn = 1 THEN value END) AS last, max(CASE WHEN rn = 2 THEN value END) AS prev,
            coalesce(arg_max(wx, t) FILTER (t = o + 36), avg(wx)) AS f FROM cutx GROUP BY series, o, tcode"""),
    ),
)
def rolling_persistence(spark, d):
    """All factors, held at their last value, in every rolling window: each series repeats its last transformed value.

    Runs the whole rolling pipeline on a model whose forecast is known in closed form.
    """
    spec = factor.FactorSpec(k=25, min_obs=24, dynamics="decay", persistence=1.0, horizon=1, window=PERSIST_WINDOW)
    out = factor.rolling_forecast(factor.pack_levels(coded_nation(spark, d)), spec)
    return out.select("series", "origin", "ds", rounded(F.col("value"), -2).alias("value"))


# ---------------------------------------------------------------- predictive tables

DRAWS = "SELECT CAST(l_suppkey AS VARCHAR) AS series, l_extendedprice AS value FROM lineitem"


def _price_draws(spark, d) -> DataFrame:
    """Line prices as draws of their supplier's next value."""
    return T.table(spark, d, "lineitem").select(
        panel_name("draws", "l_suppkey"), F.col("l_suppkey").cast("string").alias("series"), F.col("l_extendedprice").alias("value")
    )


@register(
    "predictive_percentiles",
    query("SELECT series, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.05), 4) AS p5, round(quantile_cont(value, 0.95), 4) AS p95, round(stddev_pop(value), 4) AS sd FROM (" + DRAWS + ") GROUP BY series"),
)
def predictive_percentiles(spark, d):
    out = predictive.interval(_price_draws(spark, d))
    return out.select("series", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "p5", "p95", "sd")])


@register(
    "predictive_prctile",
    query("""SELECT series, max(n) AS n,
        round(max(CASE WHEN i = floor(q5) THEN value END) + (max(CASE WHEN i = ceil(q5) THEN value END) - max(CASE WHEN i = floor(q5) THEN value END)) * (max(q5) - floor(max(q5))), 4) AS p5,
        round(max(CASE WHEN i = floor(q95) THEN value END) + (max(CASE WHEN i = ceil(q95) THEN value END) - max(CASE WHEN i = floor(q95) THEN value END)) * (max(q95) - floor(max(q95))), 4) AS p95
        FROM (SELECT *, least(greatest(n * 0.05 + 0.5, 1), n) AS q5, least(greatest(n * 0.95 + 0.5, 1), n) AS q95 FROM (
            SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY value) AS i FROM (""" + DRAWS + "))) GROUP BY series"),
)
def predictive_prctile(spark, d):
    out = predictive.order_statistics(_price_draws(spark, d), [0.05, 0.95])
    return out.select("series", "n", rounded(F.col("p5"), 4).alias("p5"), rounded(F.col("p95"), 4).alias("p95"))


@register(
    "trend12",
    query("SELECT series, round(regr_slope(value, t) * count(value), 6) + 0.0 AS trend FROM (SELECT * FROM sm WHERE t > (SELECT max(t) FROM sm) - 12) GROUP BY series HAVING count(value) > 3"),
)
def trend12(spark, d):
    out = predictive.recent_slope(T.supplier_month(spark, d), lookback=12)
    return out.select("series", rounded(F.col("trend"), 6).alias("trend"))


@register(
    "vol_blend",
    query("""SELECT series, round(base, 1) AS base, round(least(greatest(recent, 0.1 * base), 10 * base), 1) AS vol FROM (
        SELECT series, 0.5 * any_value(s2) + 0.5 * var_samp(d) AS base, var_samp(d) AS recent FROM (
            SELECT series, t, value - lag(value) OVER (PARTITION BY series ORDER BY t) AS d, var_samp(value) OVER (PARTITION BY series) AS s2 FROM sm) WHERE t > (SELECT max(t) FROM sm) - 11 GROUP BY series)"""),
)
def vol_blend(spark, d):
    out = predictive.blended_variance(T.supplier_month(spark, d), lookback=12)
    return out.select("series", rounded(F.col("base"), 1).alias("base"), rounded(F.col("vol"), 1).alias("vol"))


@register("predictive_draws")
def predictive_draws(spark, d):
    """One simulated month ahead for every supplier from the SVD factor model."""
    return factor.draw_next(factor.pack_levels(coded_supplier(spark, d)), READY, sims=500).select("series", "t", "mean", "p5", "p95", "sd")


@register(
    "predictive_usable",
    query("SELECT s.series, (SELECT CAST(max(t) + 1 AS INT) FROM sm) AS t, k.series IS NOT NULL AS usable, k.series IS NOT NULL AS ordered FROM (SELECT DISTINCT series FROM sm) s LEFT JOIN (SELECT DISTINCT series FROM kept) k USING (series)", *READY_SQL),
)
def predictive_usable(spark, d):
    """Every series of the panel, whether it could be forecast, and whether its interval holds its mean."""
    out = factor.draw_next(factor.pack_levels(coded_supplier(spark, d)), READY, sims=200)
    inside = F.coalesce(F.col("mean").between(F.col("p5"), F.col("p95")), F.lit(False)) & F.col("usable")
    return out.select("series", "t", "usable", inside.alias("ordered"))
