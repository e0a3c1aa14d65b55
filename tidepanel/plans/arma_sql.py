"""AR, MA and ARMA models written for a plain SQL engine: the checks of the fleet queries.

Normal equations are tables of cells; elimination is one join per pivot.
"""

from __future__ import annotations

LONG = 8
KEY = "series, p, q"


def scaled(source: str, p: str) -> list[tuple[str, str]]:
    """``{p}z``: observed values of ``source(series, tcode, t, x)`` centred and scaled, in time order."""
    return [
        (f"{p}o", f"SELECT series, tcode, t, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, avg(x) OVER (PARTITION BY series) AS mu, stddev_pop(x) OVER (PARTITION BY series) AS sd FROM {source} WHERE x IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t)"),
        (f"{p}z", f"SELECT series, i, n, mu, sd, (x - mu) / CASE WHEN sd > 1e-12 * abs(mu) THEN sd END AS z, CAST(least({LONG}, floor(n / 4)) AS INT) AS m FROM {p}o"),
    ]


def _lags(column: str, count: int) -> str:
    return ", ".join(f"lag({column}, {k}) OVER w" for k in range(1, count + 1))


def solved(rows: str, size: int, used: str, out: str) -> list[tuple[str, str]]:
    """Regression of the last of ``size`` values of the list ``v`` on those that ``used`` (a condition on ``i``) picks,
    per (series, p, q) of ``rows``: ``{out}c(series, p, q, i, a)`` and the sum of squares ``{out}rss``."""
    target = size - 1
    cell = f"SELECT {KEY}, i, j, sum(v[i + 1] * v[j + 1]) AS a FROM {rows}, (SELECT unnest(range({size})) AS i), (SELECT unnest(range({size})) AS j) GROUP BY ALL"
    pick = lambda c: "(" + used.replace("$", c) + ")"
    tables = [(f"{out}g", cell), (f"{out}s0", f"SELECT * FROM {out}g WHERE {pick('i')} AND ({pick('j')} OR j = {target})")]
    same = lambda x: f"{x}.series = m.series AND {x}.p = m.p AND {x}.q = m.q"
    for t in range(target):
        src = f"{out}s{t}"
        tables.append((f"{out}s{t + 1}", f"""SELECT m.series, m.p, m.q, m.i, m.j, CASE WHEN pp.a IS NULL THEN m.a WHEN m.i = {t} THEN m.a / pp.a ELSE m.a - c.a * r.a / pp.a END AS a FROM {src} m
            LEFT JOIN {src} pp ON {same('pp')} AND pp.i = {t} AND pp.j = {t} LEFT JOIN {src} r ON {same('r')} AND r.i = {t} AND r.j = m.j LEFT JOIN {src} c ON {same('c')} AND c.i = m.i AND c.j = {t}"""))
    tables.append((f"{out}c", f"SELECT {KEY}, i, a FROM {out}s{target} WHERE j = {target}"))
    tables.append((f"{out}rss", f"""SELECT g.series, g.p, g.q, max(CASE WHEN g.i = {target} THEN g.a END) - sum(CASE WHEN g.i < {target} THEN g.a * c.a END) AS rss, count(c.a) AS used
        FROM {out}g g LEFT JOIN {out}c c ON c.series = g.series AND c.p = g.p AND c.q = g.q AND c.i = g.i WHERE g.j = {target} GROUP BY g.series, g.p, g.q"""))
    return tables


def innovations(p: str) -> list[tuple[str, str]]:
    """``{p}e(series, i, z, e, ...)`` from the long autoregression of ``{p}z``."""
    return [
        (f"{p}lr", f"SELECT series, m AS p, 0 AS q, i, [1.0, {_lags('z', LONG)}, z] AS v FROM {p}z WINDOW w AS (PARTITION BY series ORDER BY i)"),
        (f"{p}lf", f"SELECT series, p, q, v FROM {p}lr WHERE i > p"),
        *solved(f"{p}lf", LONG + 2, "$ <= p", f"{p}l"),
        (f"{p}lc_", f"SELECT series, list(a ORDER BY i) AS c FROM {p}lc GROUP BY series"),
        (f"{p}e", f"""SELECT z.*, CASE WHEN z.i > m THEN z - list_sum(list_transform(range(1, len(c) + 1), lambda k: c[k] * v[k])) END AS e
            FROM {p}z z JOIN {p}lr lr ON lr.series = z.series AND lr.i = z.i JOIN {p}lc_ lc ON lc.series = z.series"""),
    ]


def model(p: str, source: str, orders: str, max_p: int, max_q: int, skip: str, horizon: int, damped: bool) -> list[tuple[str, str]]:
    """``{p}model(series, p, q, aic, path)`` of the orders in ``orders(series, p, q)``; ``skip`` rows come first."""
    e = f", {_lags('e', max_q)}" if max_q else ""
    z = f"{_lags('z', max_p)}, " if max_p else ""
    first, size = 1 + max_p, 2 + max_p + max_q
    lead = f"[1.0, {z}{e.removeprefix(', ')}{', ' if e else ''}z]".replace(", , ", ", ")
    e_now = "e" if max_q else "0.0"
    tables = [
        (f"{p}mr", f"SELECT series, i, {'m' if max_q else '0'} AS m, {lead} AS v, [z, {_lags('z', max(max_p - 1, 1))}] AS zs, [{e_now}{', ' + _lags(e_now, max_q - 1) if max_q > 1 else ''}] AS es FROM {source} WINDOW w AS (PARTITION BY series ORDER BY i)"),
        (f"{p}mf", f"SELECT r.series, o.p, o.q, r.v FROM {p}mr r JOIN {orders} o USING (series) WHERE r.i > r.m + {skip}"),
        *solved(f"{p}mf", size, f"$ <= p OR ($ >= {first} AND $ < {first} + q)", f"{p}m"),
        (f"{p}ml", f"SELECT series, p, q, list(a ORDER BY i) AS c, min(CASE WHEN isfinite(a) THEN 1 ELSE 0 END) AS fine FROM {p}mc GROUP BY ALL"),
        (f"{p}last", f"SELECT series, arg_max(zs, i) AS zs, arg_max(es, i) AS es FROM {p}mr GROUP BY series"),
        (f"{p}size", f"SELECT series, p, q, count(*) AS size FROM {p}mf GROUP BY ALL"),
        (f"{p}ma", f"""SELECT l.series, l.p, l.q, mu, sd, c[1] AS c0, list_transform(range(1, {max(max_p, 1)} + 1), lambda k: CASE WHEN k <= l.p THEN c[1 + k] ELSE 0.0 END) AS a, list_slice(c, l.p + 2, l.p + 1 + l.q) AS b, zs, es,
            size * (ln(rss / size * sd * sd) + ln(2 * pi()) + 1) + 2 * (used + 1) AS aic FROM {p}ml l JOIN {p}unit USING (series) JOIN {p}last USING (series) JOIN {p}size s ON s.series = l.series AND s.p = l.p AND s.q = l.q
            JOIN {p}mrss r ON r.series = l.series AND r.p = l.p AND r.q = l.q WHERE fine = 1 AND size > used + 1 AND rss > 1e-12 * size"""),
    ]
    tables.insert(-1, (f"{p}unit", f"SELECT DISTINCT series, mu, sd FROM {source}"))
    if damped:
        tables += [
            (f"{p}d3", f"SELECT *, a[3] AS k3, (a[1] + a[3] * a[2]) / (1 - a[3] * a[3]) AS d1, (a[2] + a[3] * a[1]) / (1 - a[3] * a[3]) AS d2 FROM {p}ma"),
            (f"{p}st0", f"SELECT * EXCLUDE (k3, d1, d2), zs AS past FROM {p}d3 WHERE abs(k3) < 0.999 AND abs(d2) < 0.999 AND abs((d1 + d2 * d1) / (1 - d2 * d2)) < 0.999"),
        ]
    else:
        tables.append((f"{p}st0", f"SELECT *, zs AS past FROM {p}ma"))
    for h in range(1, horizon + 1):
        heard = f"coalesce(list_sum(list_transform(range({h}, q + 1), lambda j: coalesce(b[j] * es[j - {h} + 1], 0))), 0)"
        own = f"coalesce(list_sum(list_transform(range(1, {max_p} + 1), lambda k: coalesce(a[k] * past[k], 0))), 0)"
        tables.append((f"{p}st{h}", f"SELECT * EXCLUDE (past), list_prepend(c0 + {own} + {heard}, past) AS past FROM {p}st{h - 1}"))
    tables.append((f"{p}model", f"SELECT series, p, q, aic, list_transform(list_reverse(list_slice(past, 1, {horizon})), lambda v: mu + sd * v) AS path FROM {p}st{horizon}"))
    return tables


def steps(name: str, p: str, chosen: str, fallback: str, least: int, horizon: int) -> tuple[str, str]:
    """``name(series, tcode, h, f)`` of all series of ``{p}o``: the chosen model's path or the fallback, NULL if short."""
    return name, f"""SELECT s.series, s.tcode, CAST(h AS INT) AS h, CASE WHEN s.n < {least} THEN NULL WHEN c.path IS NULL THEN {fallback} ELSE c.path[h] END AS f
        FROM (SELECT series, any_value(tcode) AS tcode, any_value(n) AS n, any_value(mu) AS mu, arg_max(x, i) AS x_last FROM {p}o GROUP BY series) s
        CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS h) LEFT JOIN {chosen} c USING (series)"""


def correlogram_order(p: str, partial: bool) -> list[tuple[str, str]]:
    """``{p}order(series, n, ord)``: one less than the first lag inside the band."""
    out = [
        (f"{p}led", f"SELECT series, n, x - mu AS e, " + ", ".join(f"lead(x - mu, {k}) OVER w AS e{k}" for k in range(1, 13)) + f" FROM {p}o WINDOW w AS (PARTITION BY series ORDER BY i)"),
        (f"{p}rho", "SELECT series, n, " + ", ".join(f"sum(e * e{k}) / nullif(sum(e * e), 0) AS r{k}" for k in range(1, 13)) + f" FROM {p}led GROUP BY series, n"),
    ]
    last = f"{p}rho"
    names = [f"r{k}" for k in range(1, 13)]
    if partial:
        out.append((f"{p}dl1", f"SELECT *, r1 AS a1, r1 AS p1_1 FROM {last}"))
        for k in range(2, 13):
            above = f"r{k} - (" + " + ".join(f"p{k - 1}_{j} * r{k - j}" for j in range(1, k)) + ")"
            below = "1 - (" + " + ".join(f"p{k - 1}_{j} * r{j}" for j in range(1, k)) + ")"
            out.append((f"{p}dla{k}", f"SELECT *, ({above}) / ({below}) AS a{k} FROM {p}dl{k - 1}"))
            out.append((f"{p}dl{k}", "SELECT *, " + ", ".join(f"p{k - 1}_{j} - a{k} * p{k - 1}_{k - j} AS p{k}_{j}" for j in range(1, k)) + f", a{k} AS p{k}_{k} FROM {p}dla{k}"))
        last, names = f"{p}dl12", [f"a{k}" for k in range(1, 13)]
    first = "CASE " + " ".join(f"WHEN abs({c}) < 1.96 / sqrt(n) THEN {k}" for k, c in enumerate(names, 1)) + " END"
    out.append((f"{p}order", f"SELECT series, n, CASE WHEN n < 22 THEN 1 ELSE coalesce(greatest({first} - 1, 1), 12) END AS ord FROM {last}"))
    return out


def ar(source: str, p: str, horizon: int) -> list[tuple[str, str]]:
    orders = f"SELECT series, CAST(greatest(1, least(ord, floor(n / 3))) AS INT) AS p, 0 AS q FROM {p}order"
    return [*scaled(source, p), *correlogram_order(p, True), (f"{p}orders", orders), *model(p, f"{p}z", f"{p}orders", 12, 0, "o.p", horizon, False), steps(f"{p}f", p, f"{p}model", "s.mu", 20, horizon)]


def ma(source: str, p: str, horizon: int) -> list[tuple[str, str]]:
    orders = f"SELECT series, 0 AS p, CAST(greatest(1, least(ord, floor(n / 4))) AS INT) AS q FROM {p}order"
    return [
        *scaled(source, p), *correlogram_order(p, False), (f"{p}orders", orders), *innovations(p),
        *model(p, f"{p}e", f"{p}orders", 0, 12, "o.q", horizon, False), steps(f"{p}f", p, f"{p}model", "s.mu", 20, horizon),
    ]


def arima(source: str, p: str, horizon: int) -> list[tuple[str, str]]:
    orders = f"SELECT series, p, q FROM (SELECT DISTINCT series FROM {p}o WHERE n >= 30), (SELECT unnest(range(4)) AS p), (SELECT unnest(range(4)) AS q) WHERE p + q > 0"
    best = f"SELECT series, arg_min(path, (aic, p, q)) AS path FROM {p}model GROUP BY series"
    return [
        *scaled(source, p), *innovations(p), (f"{p}orders", orders), *model(p, f"{p}e", f"{p}orders", 3, 3, "3", horizon, True), (f"{p}best", best),
        steps(f"{p}f", p, f"{p}best", "s.x_last", 30, horizon),
    ]
