"""Queries over state-space and Bayesian factor models, rolling forecasts and model-based filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import rounded
from tidepanel.operators import bayes, factor, impute
from tidepanel.panel import KEYS, with_meta
from tidepanel.plans.catalog import register
from tidepanel.plans.factor_queries import READY, coded_supplier
from tidepanel.plans.panel_queries import coded_nation
from tidepanel.plans.panels_sql import HORIZON, query
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as T

DFM = factor.FactorSpec(k=2, min_obs=60, order=1, horizon=HORIZON)
SMALL = factor.FactorSpec(k=2, prepare="ready", dynamics="ar1", horizon=1)


def region_packed(spark, d):
    """Five panels, one per region."""
    return factor.pack_levels(with_meta(T.region_month(spark, d), T.region_meta(spark, d)))


@register("dfm_em")
def dfm_em(spark, d):
    """State-space factor forecasts of the nation panel by EM."""
    return bayes.dfm_forecast(factor.pack_levels(coded_nation(spark, d)), DFM, iterations=30)


@register("dfm_em_distributed")
def dfm_em_distributed(spark, d):
    """The same model fitted iteration by iteration over the series, as for a panel too large for a task."""
    return bayes.dfm_forecast(factor.pack_levels(coded_nation(spark, d)), DFM, iterations=3, max_cells=0)


@register("gibbs_draws")
def gibbs_draws(spark, d):
    draws = bayes.gibbs(region_packed(spark, d), SMALL, n_samples=60, n_tune=30, chains=2, seed=7)
    return bayes.posterior_means(draws)


@register("gibbs_distributed")
def gibbs_distributed(spark, d):
    draws = bayes.gibbs(factor.pack_levels(coded_nation(spark, d)), READY, n_samples=2, n_tune=1, seed=7, max_cells=0)
    return bayes.posterior_means(draws)


@register("bayes_forecast")
def bayes_forecast(spark, d):
    packed = region_packed(spark, d)
    draws = bayes.gibbs(packed, SMALL, n_samples=60, n_tune=30, seed=7)
    return bayes.predict(packed, SMALL, draws, "bayesian", horizon=3, sims=300, seed=7).drop("draws", "usable")


@register("bayes_ar_forecast")
def bayes_ar_forecast(spark, d):
    packed = region_packed(spark, d)
    draws = bayes.gibbs(packed, SMALL, n_samples=60, n_tune=30, seed=7)
    return bayes.predict(packed, SMALL, draws, "bayesian-ar", horizon=3, sims=300, seed=7).drop("draws", "usable")


@register("rolling_midpoint")
def rolling_midpoint(spark, d):
    """Two months ahead with mid-point percentiles."""
    packed = factor.pack_levels(coded_supplier(spark, d))
    return bayes.rolling_horizon(packed, READY, 2, sims=300, seed=7, midpoint=True).drop("draws")


@register("rolling_bayes")
def rolling_bayes(spark, d):
    """Three months ahead for every supplier, each month refitted on the means before it."""
    return bayes.rolling_horizon(factor.pack_levels(coded_supplier(spark, d)), READY, 3, sims=300, seed=7).drop("draws")


@register(
    "rolling_methods",
    query(
        """SELECT method, CAST(h AS INT) AS h, CAST(hi + to_months(h) AS DATE) AS ds, status, count(*) AS n_series
        FROM shares, (SELECT unnest([1, 2]) AS h), (SELECT unnest(['efficient', 'bayesian', 'bayesian-ar']) AS method) GROUP BY ALL""",
        # every region has a calendar of its own
        ("spans", "SELECT group_name, min(ds) AS lo, max(ds) AS hi FROM nm_cells JOIN nmeta USING (series) GROUP BY group_name"),
        ("shares", """SELECT series, hi, CASE WHEN avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) < 0.2 THEN 'ok' ELSE 'not usable' END AS status FROM nmx JOIN nmeta USING (series) JOIN spans USING (group_name)
            WHERE nmx.ds >= lo + INTERVAL 2 MONTH AND nmx.ds <= hi GROUP BY series, hi"""),
    ),
)
def rolling_methods(spark, d):
    """Two months ahead by every method: what became of each step. Draws are fewer than the default, the steps are not."""
    packed = cut_lineage(region_packed(spark, d))
    runs = [
        bayes.rolling_horizon(packed, SMALL, 2, method=m, sims=200, seed=7, **({} if m == "efficient" else {"n_samples": 60, "n_tune": 30})).withColumn("method", F.lit(m))
        for m in bayes.METHODS
    ]
    return reduce(DataFrame.unionByName, runs).groupBy("method", "h", "ds", "status").agg(F.count(F.lit(1)).alias("n_series"))


@register("fill_gaps")
def fill_gaps(spark, d):
    """Every interior and trailing gap of the nation panel, filled in time order."""
    filled = bayes.fill_gaps(factor.pack_levels(coded_nation(spark, d)), SMALL, sims=200, seed=7)
    return bayes.unpack_levels(filled.drop("filled")).select("series", "t", "ds", "value")


@register("fill_keeps_observed", query("SELECT series, t, ds, round(value, 2) AS value FROM nm WHERE value IS NOT NULL"))
def fill_keeps_observed(spark, d):
    """The filled nation panel without the filled cells: the observed ones, unchanged."""
    filled = bayes.fill_gaps(factor.pack_levels(coded_nation(spark, d)), SMALL, sims=50, seed=7)
    observed = bayes.unpack_levels(filled, "filled").filter(~F.array_contains("filled", F.col("t")) & F.col("value").isNotNull())
    return observed.select("series", "t", "ds", rounded(F.col("value"), 2).alias("value"))


@register("fill_trailing")
def fill_trailing(spark, d):
    """Only the ragged edge of the supplier panel, and only the rows it touches."""
    filled = bayes.fill_gaps(factor.pack_levels(coded_supplier(spark, d)), READY, ("trailing",), sims=300, seed=7)
    rows = bayes.unpack_levels(filled, "filled")
    touched = rows.filter(F.array_contains("filled", F.col("t"))).select("panel_id", "ds").distinct()
    return impute.touched_rows(rows, touched).select(*KEYS, "t", "ds", "value")
