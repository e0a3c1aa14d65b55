"""Queries over sources, sinks, dates, selection, transforms, inverses and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.dates import FORMATS_WIDE, future_month_start, future_same_day, horizon_label, month_key, parse_date_column, unpadded
from tidepanel.functions.scalars import add_suffix, number, range_label, rounded, strip_suffix
from tidepanel.operators import impute, inverse, select, transform
from tidepanel.panel import KEYS, panel_name, with_meta
from tidepanel.plans.catalog import register
from tidepanel.plans.panels_sql import HORIZON, anchors_sql, levels_sql, query, transform_sql
from tidepanel.sinks import tables as sinks
from tidepanel.sources import tables as T
from tidepanel.sources import wide as W

def column_names(meta: DataFrame) -> list[str]:
    """Series names in position order: the schema of a wide table, which the driver holds in any case."""
    return [r.series for r in meta.orderBy("pos").select("series").collect()]


def coded_nation(spark, d) -> DataFrame:
    return with_meta(T.nation_month(spark, d), T.nation_meta(spark, d))


def split_nation(spark, d) -> tuple[DataFrame, DataFrame]:
    """History and held-out last year of ``nation_month``."""
    return select.history_and_holdout(coded_nation(spark, d), HORIZON)


NATIONS = [f"NATION_{i}" for i in range(25)]
PIVOT = ", ".join(f"max(CASE WHEN series = '{n}' THEN value END) AS {n}" for n in NATIONS)

# ---------------------------------------------------------------- sources


def _wide_text(spark, d) -> DataFrame:
    meta = T.nation_meta(spark, d)
    return sinks.wide_rows_with_codes(T.nation_month(spark, d), meta, column_names(meta))


@register("ingest_long", query("SELECT series, ds, round(value, 2) AS value, tcode, pos FROM nm"))
def ingest_long(spark, d):
    cells, meta = W.split_wide(_wide_text(spark, d), "nation_month")
    return cells.join(meta, KEYS).select("series", "ds", rounded(F.col("value"), 2).alias("value"), "tcode", "pos")


@register("ingest_strict", query("SELECT series, count(value) AS n, min(ds) AS lo, max(ds) AS hi, max(tcode) AS tcode FROM nm GROUP BY series"))
def ingest_strict(spark, d):
    cells, meta = W.split_wide(_wide_text(spark, d), "nation_month", codes="strict", formats=FORMATS_WIDE)
    stats = cells.groupBy(*KEYS).agg(F.count("value").alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return stats.join(meta, KEYS).select("series", "n", "lo", "hi", "tcode")


@register("ingest_without_codes", query("SELECT series, 1 AS tcode, pos, round(sum(value), 2) AS total FROM nm GROUP BY series, pos"))
def ingest_without_codes(spark, d):
    meta = T.nation_meta(spark, d)
    text = sinks.to_wide(T.nation_month(spark, d), column_names(meta)).drop("ds")
    text = text.select("sasdate", *[F.col(c).cast("string").alias(c) for c in text.columns if c != "sasdate"])
    cells, meta = W.split_wide(text, "nation_month", codes="none")
    total = cells.groupBy(*KEYS).agg(rounded(F.sum("value"), 2).alias("total"))
    return meta.join(total, KEYS).select("series", "tcode", "pos", "total")


@register("ingest_forecast_rows", query("SELECT series, strftime(ds, '%Y-%m') AS month, round(value, 2) AS value FROM nm"))
def ingest_forecast_rows(spark, d):
    text = _wide_text(spark, d)
    text = text.withColumnsRenamed({c: c + "_value" for c in text.columns[1:]})
    rows = W.forecast_rows(text, "nation_month")
    return rows.select("series", month_key(F.col("ds")).alias("month"), rounded(F.col("value"), 2).alias("value"))


# ---------------------------------------------------------------- sinks


@register("pivot_wide", query(f"SELECT strftime(ds, '%-m/%-d/%Y') AS sasdate, {PIVOT} FROM nm GROUP BY ds"))
def pivot_wide(spark, d):
    meta = T.nation_meta(spark, d)
    return sinks.wide_rows(T.nation_month(spark, d), column_names(meta))


@register(
    "wide_with_code_row",
    query(
        "SELECT 'Transform:' AS sasdate, "
        + ", ".join(f"CAST(max(CASE WHEN series = '{n}' THEN tcode END) AS DOUBLE) AS {n}" for n in NATIONS)
        + f" FROM nmeta UNION ALL SELECT strftime(ds, '%-m/%-d/%Y') AS sasdate, {PIVOT} FROM nm GROUP BY ds"
    ),
)
def wide_with_code_row(spark, d):
    text = _wide_text(spark, d)
    return text.select("sasdate", *[F.col(c).cast("double").alias(c) for c in text.columns[1:]])


@register(
    "wide_with_history_row",
    query(
        "SELECT strftime(ds, '%-m/%-d/%Y') AS sasdate, "
        + ", ".join(f"max(CASE WHEN series = '{n}' THEN value END) AS {n}_value" for n in NATIONS)
        + f" FROM (SELECT series, ds, value FROM act UNION ALL SELECT series, ds, value FROM hist WHERE ds = (SELECT max(ds) FROM hist)) GROUP BY ds"
    ),
)
def wide_with_history_row(spark, d):
    history, actual = split_nation(spark, d)
    return sinks.wide_rows(sinks.with_last_actual(actual, history), column_names(T.nation_meta(spark, d)), "_value")


@register("long_output", query("SELECT ds AS sasdate, series, round(value, 2) AS forecast_value FROM act"))
def long_output(spark, d):
    out = sinks.long_rows(split_nation(spark, d)[1])
    return out.withColumn("forecast_value", rounded(F.col("forecast_value"), 2))


# ---------------------------------------------------------------- dates and text


def _date_texts(spark, d) -> DataFrame:
    """Order dates as text, merged to distinct texts; each priority class writes them its own way."""
    ds = F.col("o_orderdate").cast("date")
    kind = F.substring("o_orderpriority", 1, 1).cast("int")
    formats = ["M/d/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "M-d-yyyy"]
    text = F.coalesce(*[F.when(kind == i, F.date_format(ds, f)) for i, f in enumerate(formats, 1)], F.lit("n/a"))
    return T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("file"), text.alias("text")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")
    )


@register(
    "parse_dates",
    """SELECT o_orderpriority AS file, CASE WHEN o_orderpriority[1] IN ('1', '2', '3', '4') THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month,
        count(*) AS n, CAST(min(CASE WHEN o_orderpriority[1] IN ('1', '2', '3', '4') THEN o_orderdate END) AS DATE) AS lo,
        sum(CASE WHEN o_orderpriority[1] IN ('1', '2', '3', '4') THEN o_orderkey * day(o_orderdate) END) AS check_sum
        FROM orders GROUP BY 1, 2""",
)
def parse_dates(spark, d):
    parsed = parse_date_column(_date_texts(spark, d), "text", FORMATS_WIDE, ["file"])
    return parsed.groupBy("file", F.trunc("ds", "MM").alias("month")).agg(
        F.sum("rows").alias("n"), F.min("ds").alias("lo"), F.sum(F.col("keys") * F.day("ds")).alias("check_sum")
    )


@register("month_calendar", query("SELECT series, ds, t, round(value, 2) AS value FROM nm"))
def month_calendar(spark, d):
    return T.nation_month(spark, d).select("series", "ds", "t", rounded(F.col("value"), 2).alias("value"))


@register("hour_calendar", query("SELECT series, CAST(ds AS TIMESTAMP) AS ds, t, round(value, 6) AS value FROM eh"))
def hour_calendar(spark, d):
    return T.event_hour(spark, d).select("series", "ds", "t", rounded(F.col("value"), 6).alias("value"))


@register(
    "future_index",
    query(f"""SELECT series, h, CAST(date_trunc('month', last) + to_months(h) AS DATE) AS month_start, CAST(last + to_months(h) AS DATE) AS same_day,
        CASE WHEN h = 1 THEN '1 Month' ELSE h || ' Months' END AS label, strftime(CAST(last + to_months(h) AS DATE), '%-m/%-d/%Y') AS text
        FROM (SELECT series, max(ds) AS last FROM fd_cells GROUP BY series), (SELECT CAST(unnest(range(1, {HORIZON} + 1)) AS INT) AS h)"""),
)
def future_index(spark, d):
    last = T.flag_day(spark, d).filter("value is not null").groupBy(*KEYS).agg(F.max("ds").alias("last"))
    steps = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    h, day = F.col("h"), F.col("last")
    return steps.select(
        "series", "h", future_month_start(day, h).alias("month_start"), future_same_day(day, h).alias("same_day"),
        horizon_label(h).alias("label"), unpadded(future_same_day(day, h)).alias("text"),
    )


@register(
    "text_scalars",
    """SELECT user_id, 'u' || user_id || '_value' AS suffixed, 'u' || user_id AS plain,
        printf('[%.1f, %.1f]', min(value), max(value)) AS range_label,
        count(*) AS n, count(TRY_CAST(props->>'k' AS DOUBLE)) AS n_number, sum(TRY_CAST(props->>'k' AS DOUBLE)) AS k_sum
        FROM events GROUP BY user_id""",
)
def text_scalars(spark, d):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = T.table(spark, d, "events").withColumn("k", number(F.get_json_object("props", "$.k")))
    stats = rows.groupBy("user_id").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("k").alias("n_number"), F.sum("k").alias("k_sum")
    )
    return stats.select(
        "user_id", add_suffix(name).alias("suffixed"), strip_suffix(add_suffix(name)).alias("plain"),
        range_label(F.col("lo"), F.col("hi")).alias("range_label"), "n", "n_number", "k_sum",
    )


# ---------------------------------------------------------------- selection


def _totals(spark, d, chosen: DataFrame) -> DataFrame:
    picked = T.nation_month(spark, d).join(chosen, KEYS)
    return picked.groupBy("series", "pos", "group_id").agg(F.count("value").alias("n"), rounded(F.sum("value"), 2).alias("total"))


def _totals_sql(where: str) -> str:
    return query(f"""SELECT nm.series, nm.pos, group_id, count(value) AS n, round(sum(value), 2) AS total
        FROM nm JOIN nmeta m ON m.series = nm.series WHERE {where} GROUP BY ALL""")


@register("select_by_name", _totals_sql("nm.series IN ('NATION_3', 'NATION_17')"))
def select_by_name(spark, d):
    return _totals(spark, d, select.by_names(T.nation_meta(spark, d), ["NATION_3", "NATION_17"]))


@register("select_by_index", _totals_sql("nm.pos IN (1, 2) OR nm.pos BETWEEN 10 AND 14"))
def select_by_index(spark, d):
    return _totals(spark, d, select.by_positions(T.nation_meta(spark, d), "1,2, 14-10,12"))


@register("select_by_group", _totals_sql("group_id = 1 OR lower(group_name) LIKE '%as%'"))
def select_by_group(spark, d):
    return _totals(spark, d, select.by_groups(T.nation_meta(spark, d), "1,As"))


@register("drop_by_group", _totals_sql("group_id NOT IN (2, 3)"))
def drop_by_group(spark, d):
    return _totals(spark, d, select.drop_groups(T.nation_meta(spark, d), [2, 3]))


@register("unknown_series", "SELECT CAST(l_suppkey AS VARCHAR) AS series, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) >= (SELECT count(*) / 25.0 FROM customer))) GROUP BY ALL")
def unknown_series(spark, d):
    """Lines of suppliers from nations with fewer customers than the average of the 25."""
    customers = T.table(spark, d, "customer")
    nations = customers.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    all_nations = Window.partitionBy(panel_name("nations", "s_nationkey"))  # one row per nation
    large = nations.withColumn("mean", F.sum("n").over(all_nations) / 25.0).filter("n >= mean").select("s_nationkey")
    known = T.table(spark, d, "supplier").join(large, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    counts = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, "l_suppkey", "left_anti").select(F.col("l_suppkey").cast("string").alias("series"), "n")


@register("series_listing", query("SELECT pos, series, count(*) OVER () AS n_series FROM nmeta"))
def series_listing(spark, d):
    return select.listing(T.nation_meta(spark, d))


@register("group_sizes", query("SELECT group_id, group_name, count(*) AS n_series FROM nmeta GROUP BY ALL"))
def group_sizes(spark, d):
    return select.group_sizes(T.nation_meta(spark, d))


@register("series_search", query("SELECT series, group_id, group_id IN (2, 4) AS in_group FROM nmeta WHERE lower(series) LIKE '%on_1%'"))
def series_search(spark, d):
    return select.search(T.nation_meta(spark, d), "ON_1", [2, 4]).select("series", "group_id", "in_group")


@register("train_split", query(f"SELECT series, ds, t <= (SELECT max(t) FROM nm) - {HORIZON} AS is_train, round(value, 2) AS value FROM nm"))
def train_split(spark, d):
    marked = select.split_holdout(T.nation_month(spark, d), HORIZON)
    return marked.select("series", "ds", "is_train", rounded(F.col("value"), 2).alias("value"))


@register("usable_series", query("SELECT series, count(value) AS n, round(stddev_samp(value), 6) AS sd FROM fd GROUP BY series HAVING count(value) >= 100 AND stddev_samp(value) > 0"))
def usable_series(spark, d):
    return select.usable_by_count(T.flag_day(spark, d), "value", 100).select("series", "n", rounded(F.col("sd"), 6).alias("sd"))


@register(
    "usable_share",
    query("SELECT series, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing FROM eh GROUP BY series HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) < 1 - 0.95"),
)
def usable_share(spark, d):
    return select.usable_by_share(T.event_hour(spark, d), "value", 0.95).select("series", rounded(F.col("missing"), 9).alias("missing"))


@register("drop_empty_rows", query("SELECT series, ds FROM nmx WHERE ds IN (SELECT ds FROM nmx GROUP BY ds HAVING count(x) > 0)"))
def drop_empty_rows(spark, d):
    x = transform.stationary(coded_nation(spark, d))
    return select.drop_empty_rows(x).select("series", "ds")


@register("drop_incomplete_series", query("SELECT series, t, round(value, 2) AS value FROM sm WHERE series IN (SELECT series FROM sm GROUP BY series HAVING count(value) = count(*))"))
def drop_incomplete_series(spark, d):
    kept = select.drop_empty_series(T.supplier_month(spark, d), "value", complete=True)
    return kept.select("series", "t", rounded(F.col("value"), 2).alias("value"))


@register(
    "restored_columns",
    query(f"""SELECT m.series, m.pos, s.h, round(fc.value, 1) AS value FROM nmeta m
        CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON} + 1)) AS INT) AS h) s
        LEFT JOIN (SELECT naive_fc.* FROM naive_fc WHERE series IN (SELECT series FROM hist GROUP BY series HAVING count(value) = count(*))) fc ON fc.series = m.series AND fc.h = s.h"""),
)
def restored_columns(spark, d):
    from tidepanel.operators.univariate import naive

    history, _ = split_nation(spark, d)
    fc = naive(select.drop_empty_series(history, "value", complete=True), HORIZON).drop("ds")
    whole = select.restore_columns(fc, T.nation_meta(spark, d), HORIZON)
    return whole.select("series", "pos", "h", rounded(F.col("f"), 1).alias("value"))


# ---------------------------------------------------------------- transforms


@register("tcode_transform", query("SELECT series, t, tcode, round(x, 6) + 0.0 AS x FROM nmx"))
def tcode_transform(spark, d):
    x = transform.stationary(coded_nation(spark, d))
    return x.select("series", "t", "tcode", rounded(F.col("x"), 6).alias("x"))


@register("tcode_transform_fleet", query("SELECT series, t, tcode, round(x, 5) + 0.0 AS x FROM smx", ("smx", transform_sql("sm"))))
def tcode_transform_fleet(spark, d):
    x = transform.stationary(with_meta(T.supplier_month(spark, d), T.supplier_meta(spark, d)))
    return x.select("series", "t", "tcode", rounded(F.col("x"), 5).alias("x"))


@register(
    "tcode_signed",
    query("SELECT series, t, tcode, round(x, 6) + 0.0 AS x FROM sdx", ("sdc", "SELECT *, CAST(length(series) % 7 + 1 AS INT) AS tcode FROM sd"), ("sdx", transform_sql("sdc"))),
)
def tcode_signed(spark, d):
    coded = T.signed_day(spark, d).withColumn("tcode", (F.length("series") % 7 + 1).cast("int"))
    return transform.stationary(coded).select("series", "t", "tcode", rounded(F.col("x"), 6).alias("x"))


@register(
    "tcode_logs_signed",
    query("SELECT series, t, tcode, round(x, 6) + 0.0 AS x FROM sdx", ("sdc", "SELECT *, CAST(4 + t % 4 AS INT) AS tcode FROM sd"), ("sdx", transform_sql("sdc"))),
)
def tcode_logs_signed(spark, d):
    coded = T.signed_day(spark, d).withColumn("tcode", (4 + F.col("t") % 4).cast("int"))
    return transform.stationary(coded).select("series", "t", "tcode", rounded(F.col("x"), 6).alias("x"))


STD = """SELECT series, t, x, round(({x} - coalesce(avg(x) OVER w, 0)) / CASE WHEN {sd}(x) OVER w > 0 THEN {sd}(x) OVER w ELSE 1 END, 6) + 0.0 AS z
    FROM {src} WINDOW w AS (PARTITION BY series)"""


@register("standardize", query("SELECT series, t, z FROM (" + STD.format(x="x", sd="stddev_samp", src="nmx") + ")"))
def standardize(spark, d):
    z = transform.standardize(transform.stationary(coded_nation(spark, d)))
    return z.select("series", "t", rounded(F.col("z"), 6).alias("z"))


@register("standardize_population", query("SELECT series, t, z FROM (" + STD.format(x="x", sd="stddev_pop", src="nmx") + ")"))
def standardize_population(spark, d):
    z = transform.standardize(transform.stationary(coded_nation(spark, d)), ddof=0)
    return z.select("series", "t", rounded(F.col("z"), 6).alias("z"))


@register("unstandardize", query("SELECT series, t, round(value, 2) AS x FROM fd WHERE value IS NOT NULL"))
def unstandardize(spark, d):
    panel = T.flag_day(spark, d)
    z = transform.standardize(panel, "value").select("panel_id", "series", "t", "z")
    back = transform.unstandardize(z, transform.moments(panel, "value"))
    return back.filter("x is not null").select("series", "t", rounded(F.col("x"), 2).alias("x"))


@register(
    "normalize_100",
    query("SELECT series, t, round(100 * value / nullif(first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) + 0.0 AS index_100 FROM sm"),
)
def normalize_100(spark, d):
    return transform.index_to_100(T.supplier_month(spark, d)).select("series", "t", rounded(F.col("index_100"), 6).alias("index_100"))


@register(
    "period_change",
    query("SELECT series, t, round(value - lag(value) OVER w, 4) + 0.0 AS chg, round((value / nullif(lag(value) OVER w, 0) - 1) * 100, 6) + 0.0 AS pct FROM sd WINDOW w AS (PARTITION BY series ORDER BY t)"),
)
def period_change(spark, d):
    out = transform.period_change(T.signed_day(spark, d))
    return out.select("series", "t", rounded(F.col("chg"), 4).alias("chg"), rounded(F.col("pct"), 6).alias("pct"))


# ---------------------------------------------------------------- inverse transforms

ROUND_TRIP = (
    ("ftr", f"SELECT series, tcode, CAST(t - ((SELECT max(t) FROM nm) - {HORIZON}) AS INT) AS h, x AS f FROM nmx WHERE t > (SELECT max(t) FROM nm) - {HORIZON}"),
)


def _held_out_steps(spark, d) -> tuple[DataFrame, DataFrame]:
    """The true transformed values of the last year as a forecast, and the anchors before it."""
    history, late = select.history_and_holdout(transform.stationary(coded_nation(spark, d)), HORIZON)
    steps = late.select(*KEYS, "tcode", (F.col("t") - F.col("n_periods") + HORIZON).alias("h"), F.col("x").alias("f"))
    return steps, inverse.anchors(history)


@register("anchors", query("SELECT series, round(last, 2) AS last, round(prev, 2) AS prev FROM (" + anchors_sql("sm") + ")"))
def anchors(spark, d):
    a = inverse.anchors(T.supplier_month(spark, d))
    return a.select("series", rounded(F.col("last"), 2).alias("last"), rounded(F.col("prev"), 2).alias("prev"))


@register("tcode_inverse", query("SELECT series, h, tcode, round(value, 1) + 0.0 AS value FROM (" + levels_sql("ftr", "hist_anchor") + ")", *ROUND_TRIP))
def tcode_inverse(spark, d):
    out = inverse.to_levels(*_held_out_steps(spark, d))
    return out.select("series", "h", "tcode", rounded(F.col("value"), 1).alias("value"))


@register("tcode_inverse_repeat", query("SELECT series, h, tcode, round(value, 1) + 0.0 AS value FROM (" + levels_sql("ftr", "hist_anchor", "repeat") + ")", *ROUND_TRIP))
def tcode_inverse_repeat(spark, d):
    out = inverse.to_levels(*_held_out_steps(spark, d), guard="repeat")
    return out.select("series", "h", "tcode", rounded(F.col("value"), 1).alias("value"))


SIMULATED = """SELECT CAST(l_suppkey AS VARCHAR) AS series, l_orderkey, l_linenumber, CAST(l_suppkey % 7 + 1 AS INT) AS tcode,
    (l_discount - 0.05) AS f FROM lineitem"""
ONE_STEP = """CASE WHEN last IS NOT NULL AND f IS NOT NULL THEN CASE tcode WHEN 2 THEN last + f WHEN 3 THEN 2 * last - coalesce(prev, last) + f
    WHEN 4 THEN exp(f) WHEN 5 THEN CASE WHEN last > 0 THEN last * exp(f) ELSE last END
    WHEN 6 THEN CASE WHEN last > 0 AND coalesce(prev, last) > 0 THEN last * exp(ln(last) - ln(coalesce(prev, last)) + f) ELSE last END
    WHEN 7 THEN CASE WHEN coalesce(prev, last) <> 0 THEN last * (last / coalesce(prev, last) + f) ELSE last END ELSE f END END"""


def _simulated(spark, d) -> DataFrame:
    """Line discounts as simulated one-step values of their supplier's series."""
    return T.table(spark, d, "lineitem").select(
        panel_name("supplier_month", "l_suppkey"), F.col("l_suppkey").cast("string").alias("series"), "l_orderkey", "l_linenumber",
        (F.col("l_suppkey") % 7 + 1).cast("int").alias("tcode"), (F.col("l_discount") - 0.05).alias("f"),
    )


@register(
    "inverse_one_step",
    query(f"""SELECT series, tcode, count(v) AS n, round(avg(v), 4) + 0.0 AS mean, round(min(v), 4) + 0.0 AS lo, round(max(v), 4) + 0.0 AS hi
        FROM (SELECT s.*, {ONE_STEP} AS v FROM sim s JOIN sa a USING (series)) GROUP BY series, tcode""",
        ("sim", SIMULATED), ("sa", anchors_sql("sm"))),
)
def inverse_one_step(spark, d):
    anchor = inverse.anchors(T.supplier_month(spark, d))
    v = inverse.next_level(F.col("f"), F.col("last"), F.col("prev"), F.col("tcode"))
    out = _simulated(spark, d).join(anchor, KEYS).withColumn("v", v)
    return out.groupBy("series", "tcode").agg(
        F.count("v").alias("n"), rounded(F.avg("v"), 4).alias("mean"), rounded(F.min("v"), 4).alias("lo"), rounded(F.max("v"), 4).alias("hi")
    )


@register(
    "inverse_blend_clip",
    query(
        f"""SELECT series, tcode, round(CASE WHEN tcode >= 4 AND sd > 0 THEN greatest(least(v, mu + 5 * sd), mu - 5 * sd) ELSE v END, 4) + 0.0 AS value FROM (
        SELECT s.series, s.tcode, mu, sd, CASE
            WHEN tcode = 5 AND last > 0 AND n >= 3 AND np >= 3 THEN last * exp(0.7 * f + 0.3 * g)
            WHEN tcode = 6 AND last > 0 AND prev > 0 AND n >= 4 AND np >= 4 THEN last * exp(ln(last) - ln(prev) + 0.7 * f + 0.3 * acc)
            WHEN tcode = 7 AND prev <> 0 AND n >= 4 AND rg IS NOT NULL THEN last * (1 + last / prev - 1 + 0.7 * f + 0.3 * (rg - (last / prev - 1)))
            ELSE {ONE_STEP} END AS v
        FROM one s JOIN sa USING (series) JOIN tr USING (series))""",
        ("one", "SELECT series, max(tcode) AS tcode, avg(f) AS f FROM (" + SIMULATED + ") GROUP BY series"),
        ("sa", anchors_sql("sm")),
        ("obs", "SELECT *, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS rn FROM sm WHERE value IS NOT NULL"),
        ("lg", "SELECT series, t, ln(value) AS lv FROM obs WHERE rn <= 12 AND value > 0"),
        ("dl", "SELECT *, lv - lag(lv) OVER (PARTITION BY series ORDER BY t) AS d1 FROM lg"),
        ("dd", "SELECT *, d1 - lag(d1) OVER (PARTITION BY series ORDER BY t) AS d2 FROM dl"),
        ("pc", "SELECT series, value / nullif(lag(value) OVER (PARTITION BY series ORDER BY t), 0) - 1 AS p FROM obs WHERE rn <= 12"),
        ("tr", """SELECT o.series, count(*) FILTER (rn <= 12) AS n, avg(value) AS mu, stddev_samp(value) AS sd, any_value(np) AS np, any_value(g) AS g, any_value(acc) AS acc, any_value(rg) AS rg
            FROM obs o LEFT JOIN (SELECT series, count(*) AS np, avg(d1) AS g, avg(d2) AS acc FROM dd GROUP BY series) USING (series)
            LEFT JOIN (SELECT series, avg(p) AS rg FROM pc GROUP BY series) USING (series) GROUP BY o.series"""),
    ),
)
def inverse_blend_clip(spark, d):
    panel = T.supplier_month(spark, d)
    steps = _simulated(spark, d).groupBy(*KEYS).agg(F.max("tcode").alias("tcode"), F.avg("f").alias("f"))
    out = inverse.blended_level(steps, inverse.anchors(panel), inverse.recent_trend(panel))
    return out.select("series", "tcode", rounded(F.col("value"), 4).alias("value"))


# ---------------------------------------------------------------- imputation

NEAR = """SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS qt,
    last_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER b AS pd, first_value(CASE WHEN value IS NOT NULL THEN ds END IGNORE NULLS) OVER a AS qd,
    last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER a AS qv FROM {src}
    WINDOW b AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
FIRST3 = """coalesce(value, CASE WHEN t - pt <= 3 THEN CASE WHEN qv IS NULL THEN pv ELSE pv + (qv - pv) * (epoch(ds) - epoch(pd)) / (epoch(qd) - epoch(pd)) END END)"""
GAP3 = "coalesce(value, CASE WHEN qt - pt - 1 <= 3 THEN pv + (qv - pv) * (t - pt) / (qt - pt) END)"


@register("interp_first3", query(f"SELECT series, t, round({FIRST3}, 6) + 0.0 AS value FROM near", ("near", NEAR.format(src="eh"))))
def interp_first3(spark, d):
    return impute.interpolate_first(T.event_hour(spark, d)).select("series", "t", rounded(F.col("value"), 6).alias("value"))


@register("interp_first3_months", query(f"SELECT series, t, round({FIRST3}, 4) + 0.0 AS value FROM near", ("near", NEAR.format(src="sm"))))
def interp_first3_months(spark, d):
    return impute.interpolate_first(T.supplier_month(spark, d)).select("series", "t", rounded(F.col("value"), 4).alias("value"))


@register("interp_gap3", query(f"SELECT series, t, round({GAP3}, 6) + 0.0 AS value FROM near", ("near", NEAR.format(src="eh"))))
def interp_gap3(spark, d):
    return impute.interpolate_short(T.event_hour(spark, d)).select("series", "t", rounded(F.col("value"), 6).alias("value"))


@register("ffill_bfill", query("SELECT series, t, round(coalesce(pv, qv), 6) + 0.0 AS value FROM near", ("near", NEAR.format(src="eh"))))
def ffill_bfill(spark, d):
    return impute.carry(T.event_hour(spark, d)).select("series", "t", rounded(F.col("value"), 6).alias("value"))


@register("mean_impute", query("SELECT series, t, round(coalesce(value, avg(value) OVER (PARTITION BY series)), 6) + 0.0 AS value FROM eh"))
def mean_impute(spark, d):
    return impute.fill_mean(T.event_hour(spark, d), "value").select("series", "t", rounded(F.col("value"), 6).alias("value"))


@register(
    "ragged_edge",
    query("SELECT series, lv AS last_valid, lv + 1 AS missing_start, mt - lv AS n_missing FROM (SELECT series, max(t) FILTER (value IS NOT NULL) AS lv, max(t) AS mt FROM sm GROUP BY series) WHERE lv < mt"),
)
def ragged_edge(spark, d):
    return impute.ragged_edge(T.supplier_month(spark, d)).select("series", "last_valid", "missing_start", "n_missing")


GAPS = """SELECT series, t, ds, CASE WHEN t < l THEN 'interior' ELSE 'trailing' END AS kind FROM (
    SELECT *, min(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series) AS f, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY series) AS l FROM {src})
    WHERE value IS NULL AND t > f"""


@register("gap_cells", query("SELECT series, t, kind FROM (" + GAPS.format(src="eh") + ")"))
def gap_cells(spark, d):
    return impute.gap_cells(T.event_hour(spark, d)).select("series", "t", "kind")


@register(
    "gap_report",
    query("SELECT kind, count(*) AS n_cells, count(DISTINCT series) AS n_series, count(DISTINCT t) AS n_periods, min(t) AS first_t, max(t) AS last_t FROM (" + GAPS.format(src="sm") + ") GROUP BY kind"),
)
def gap_report(spark, d):
    return impute.gap_summary(impute.gap_cells(T.supplier_month(spark, d))).drop("panel_id")


@register("most_filled", query("SELECT series, count(*) AS n_filled FROM (" + GAPS.format(src="sm") + ") GROUP BY series ORDER BY n_filled DESC, series LIMIT 10"))
def most_filled(spark, d):
    return impute.most_filled(impute.gap_cells(T.supplier_month(spark, d))).select("series", "n_filled")


@register("touched_rows", query("SELECT series, t, round(value, 2) AS value FROM sm WHERE ds IN (SELECT ds FROM (" + GAPS.format(src="sm") + "))"))
def touched_rows(spark, d):
    panel = T.supplier_month(spark, d)
    return impute.touched_rows(panel, impute.gap_cells(panel)).select("series", "t", rounded(F.col("value"), 2).alias("value"))


READY = (
    ("smx", transform_sql("sm")),
    ("cut", "SELECT series, t, ds, x AS value FROM smx WHERE t > 2"),
    ("kept", "SELECT * FROM cut WHERE series IN (SELECT series FROM cut GROUP BY series HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) < 1 - 0.8)"),
    ("near", NEAR.format(src="kept")),
)


def _ready_sql(fill: str) -> str:
    return query(
        "SELECT series, t, round((v - avg(v) OVER w) / CASE WHEN stddev_samp(v) OVER w > 0 THEN stddev_samp(v) OVER w ELSE 1 END, 6) + 0.0 AS z FROM carried WINDOW w AS (PARTITION BY series)",
        *READY,
        ("filled", f"SELECT series, t, {fill} AS v FROM near"),
        ("carried", """SELECT series, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM filled"""),
    )


def _model_ready(spark, d, **options):
    x = transform.stationary(with_meta(T.supplier_month(spark, d), T.supplier_meta(spark, d)))
    return impute.model_ready(x, **options).select("series", "t", rounded(F.col("z"), 6).alias("z"))


@register("model_ready", _ready_sql(GAP3))
def model_ready(spark, d):
    return _model_ready(spark, d, drop_leading=True)


@register("model_ready_first3", _ready_sql(FIRST3))
def model_ready_first3(spark, d):
    return _model_ready(spark, d, rule="first")
