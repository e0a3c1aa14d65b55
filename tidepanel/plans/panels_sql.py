"""SQL building blocks for the checks: the same panels and models written for a plain SQL engine."""

from __future__ import annotations

import re

HORIZON = 12

CTES = {
    # monthly order value per nation on a full calendar, with code and position
    "nm_cells": """SELECT n_name AS series, n_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL""",
    "nm_cal": """SELECT ds, CAST(row_number() OVER (ORDER BY ds) AS INT) AS t FROM (
        SELECT CAST(unnest(generate_series((SELECT min(ds) FROM nm_cells), (SELECT max(ds) FROM nm_cells), INTERVAL 1 MONTH)) AS DATE) AS ds)""",
    "nm": """SELECT s.series, s.tcode, s.pos, c.ds, c.t, v.value
        FROM (SELECT DISTINCT series, CAST(n_nationkey % 7 + 1 AS INT) AS tcode, CAST(n_nationkey + 1 AS INT) AS pos FROM nm_cells) s
        CROSS JOIN nm_cal c LEFT JOIN nm_cells v ON v.series = s.series AND v.ds = c.ds""",
    "nmeta": """SELECT n_name AS series, CAST(n_nationkey % 7 + 1 AS INT) AS tcode, CAST(n_nationkey + 1 AS INT) AS pos,
        CAST(r_regionkey + 1 AS INT) AS group_id, r_name AS group_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # monthly revenue per supplier
    "sm_cells": """SELECT CAST(l_suppkey AS VARCHAR) AS series, CAST(l_suppkey % 7 + 1 AS INT) AS tcode,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000 AS value
        FROM lineitem GROUP BY ALL""",
    "sm_cal": """SELECT ds, CAST(row_number() OVER (ORDER BY ds) AS INT) AS t FROM (
        SELECT CAST(unnest(generate_series((SELECT min(ds) FROM sm_cells), (SELECT max(ds) FROM sm_cells), INTERVAL 1 MONTH)) AS DATE) AS ds)""",
    "sm": """SELECT s.series, s.tcode, c.ds, c.t, v.value FROM (SELECT DISTINCT series, tcode FROM sm_cells) s
        CROSS JOIN sm_cal c LEFT JOIN sm_cells v ON v.series = s.series AND v.ds = c.ds""",
    # daily quantity per flag
    "fd_cells": """SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS value
        FROM lineitem GROUP BY ALL""",
    "fd": """SELECT s.series, c.ds, c.t, v.value FROM (SELECT DISTINCT series FROM fd_cells) s
        CROSS JOIN (SELECT ds, CAST(row_number() OVER (ORDER BY ds) AS INT) AS t FROM (
            SELECT CAST(unnest(generate_series((SELECT min(ds) FROM fd_cells), (SELECT max(ds) FROM fd_cells), INTERVAL 1 DAY)) AS DATE) AS ds)) c
        LEFT JOIN fd_cells v ON v.series = s.series AND v.ds = c.ds""",
    # hourly mean per event type
    "eh_cells": """SELECT event_type AS series, date_trunc('hour', ts) AS ds,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) / 100 AS value FROM events GROUP BY ALL""",
    "eh": """SELECT s.series, c.ds, c.t, v.value FROM (SELECT DISTINCT series FROM eh_cells) s
        CROSS JOIN (SELECT ds, CAST(row_number() OVER (ORDER BY ds) AS INT) AS t FROM (
            SELECT unnest(generate_series((SELECT min(ds) FROM eh_cells), (SELECT max(ds) FROM eh_cells), INTERVAL 1 HOUR)) AS ds)) c
        LEFT JOIN eh_cells v ON v.series = s.series AND v.ds = c.ds""",
    # daily mean balance per segment
    "sd_cells": """SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS ds,
        CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "sd": """SELECT s.series, c.ds, c.t, v.value FROM (SELECT DISTINCT series FROM sd_cells) s
        CROSS JOIN (SELECT ds, CAST(row_number() OVER (ORDER BY ds) AS INT) AS t FROM (
            SELECT CAST(unnest(generate_series((SELECT min(ds) FROM sd_cells), (SELECT max(ds) FROM sd_cells), INTERVAL 1 DAY)) AS DATE) AS ds)) c
        LEFT JOIN sd_cells v ON v.series = s.series AND v.ds = c.ds""",
}


def transform_sql(source: str) -> str:
    log = lambda c: f"CASE WHEN {c} > 0 THEN ln({c}) END"
    return f"""SELECT *, CASE tcode
        WHEN 1 THEN value WHEN 2 THEN value - l1 WHEN 3 THEN value - 2 * l1 + l2
        WHEN 4 THEN {log('value')} WHEN 5 THEN ({log('value')}) - ({log('l1')})
        WHEN 6 THEN ({log('value')}) - 2 * ({log('l1')}) + ({log('l2')})
        WHEN 7 THEN value / nullif(l1, 0) - l1 / nullif(l2, 0) ELSE value END AS x
        FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY t) AS l1, lag(value, 2) OVER (PARTITION BY series ORDER BY t) AS l2 FROM {source})"""


def anchors_sql(source: str) -> str:
    return f"""SELECT series, max(value) FILTER (rn = 1) AS last, max(value) FILTER (rn = 2) AS prev FROM (
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY t DESC) AS rn FROM {source} WHERE value IS NOT NULL) GROUP BY series"""


def levels_sql(forecast: str, anchor: str, guard: str = "null") -> str:
    """Running closed forms of the inverse codes over ``forecast(series, tcode, h, f)``."""
    log = lambda c: f"(CASE WHEN {c} > 0 THEN ln({c}) END)"
    prev = "coalesce(prev, last)" if guard == "repeat" else "prev"
    level = f"""CASE tcode WHEN 2 THEN last + c1 WHEN 3 THEN last + n * (last - p) + c2 WHEN 4 THEN exp(f)
        WHEN 5 THEN exp({log('last')} + c1) WHEN 6 THEN exp({log('last')} + n * ({log('last')} - {log('p')}) + c2)
        WHEN 7 THEN last * prod ELSE f END"""
    if guard == "repeat":
        level = f"coalesce({level}, last)"
    return f"""SELECT * EXCLUDE (c1, n, c2, prod, p, last, prev), CASE WHEN f IS NOT NULL AND last IS NOT NULL THEN {level} END AS value FROM (
        SELECT *, sum(CASE WHEN f IS NOT NULL THEN c1 END) OVER w AS c2,
            product(CASE WHEN f IS NOT NULL THEN 1 + (last - p) / nullif(p, 0) + c1 END) OVER w AS prod FROM (
            SELECT fc.*, a.last, a.prev, {prev} AS p, sum(f) OVER w AS c1, count(f) OVER w AS n
            FROM {forecast} fc LEFT JOIN {anchor} a USING (series)
            WINDOW w AS (PARTITION BY series ORDER BY h ROWS UNBOUNDED PRECEDING))
        WINDOW w AS (PARTITION BY series ORDER BY h ROWS UNBOUNDED PRECEDING))"""


def add(name: str, sql: str) -> None:
    CTES[name] = sql


add("nmx", transform_sql("nm"))
# the last year of nation_month held out
add("hist", f"SELECT * FROM nm WHERE t <= (SELECT max(t) FROM nm) - {HORIZON}")
add("act", f"SELECT series, ds, t, value FROM nm WHERE t > (SELECT max(t) FROM nm) - {HORIZON}")
add("histx", transform_sql("hist"))
add(
    "ar1",
    """SELECT series, tcode, count(*) AS n, CASE WHEN count(*) >= 20 THEN regr_intercept(x, b) END AS c,
        CASE WHEN count(*) >= 20 THEN regr_slope(x, b) END AS phi, arg_max(x, t) AS x_last
        FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY t) AS b FROM histx WHERE x IS NOT NULL) GROUP BY series, tcode""",
)
add(
    "ar1_f",
    f"""SELECT series, tcode, h, CASE WHEN phi = 1 THEN c * h ELSE c * ((1 - pow(phi, h)) / (1 - phi)) END + pow(phi, h) * x_last AS f
        FROM ar1, (SELECT CAST(unnest(range(1, {HORIZON} + 1)) AS INT) AS h)""",
)
add("hist_anchor", anchors_sql("hist"))
add("ar1_levels", levels_sql("ar1_f", "hist_anchor"))
# dated forecast of the held-out year
add(
    "fc",
    """SELECT series, h, CAST(date_trunc('month', last_ds) + to_months(h) AS DATE) AS ds, value
        FROM ar1_levels, (SELECT max(ds) AS last_ds FROM hist)""",
)
add(
    "naive_fc",
    f"""SELECT series, h, CAST(date_trunc('month', last_ds) + to_months(h) AS DATE) AS ds, value
        FROM (SELECT series, arg_max(value, t) AS value FROM hist WHERE value IS NOT NULL GROUP BY series),
        (SELECT CAST(unnest(range(1, {HORIZON} + 1)) AS INT) AS h), (SELECT max(ds) AS last_ds FROM hist)""",
)


def query(body: str, *extra: tuple[str, str]) -> str:
    """``body`` with exactly the common tables it names, directly or through others."""
    local = dict(extra)
    known = {**CTES, **local}
    order = list(CTES) + [n for n in local if n not in CTES]
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql)):
            if word in known and word not in needed:
                needed.add(word)
                visit(known[word])

    visit(body)
    parts = [f"{n} AS ({known[n]})" for n in order if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
