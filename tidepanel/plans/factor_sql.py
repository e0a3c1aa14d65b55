"""Factor models written for a plain SQL engine: the checks of the factor queries.

A leading singular vector is read off a high power of the T x T cross-moment matrix, squared ``SQUARINGS`` times; the
matrix is then deflated for the next one. The Spark side never forms that matrix.
"""

from __future__ import annotations

SQUARINGS = 12


def standardised(source: str, min_obs: int) -> str:
    """``(series, t, tcode, z, mu, sd)`` of the usable series of ``source(series, t, tcode, x)``, 0 for missing cells."""
    sd = "CASE WHEN stddev_samp(x) OVER w > 0 THEN stddev_samp(x) OVER w ELSE 1 END"
    return f"""SELECT series, t, tcode, coalesce((x - avg(x) OVER w) / ({sd}), 0) AS z, avg(x) OVER w AS mu, {sd} AS sd FROM {source}
        WINDOW w AS (PARTITION BY series) QUALIFY count(x) OVER w >= {min_obs} AND max(x) OVER w > min(x) OVER w"""


def scores(z: str, k: int, p: str = "") -> list[tuple[str, str]]:
    """Tables ``{p}scores(t, k, f, l)`` with ``l`` the eigenvalue, and ``{p}gram0``."""
    out = [(f"{p}gram0", f"SELECT a.t AS i, b.t AS j, sum(a.z * b.z) AS g FROM {z} a JOIN {z} b ON a.series = b.series GROUP BY ALL")]
    for f in range(1, k + 1):
        rest, power = f"{p}gram{f - 1}", f"{p}m{f}"
        scaled = lambda src: f"SELECT i, j, g / (SELECT sum(g) FROM {src} WHERE i = j) AS g FROM {src}"
        out.append((f"{power}_0", scaled(rest)))
        for s in range(1, SQUARINGS + 1):
            out.append((f"{power}_{s}r", f"SELECT a.i, b.j, sum(a.g * b.g) AS g FROM {power}_{s - 1} a JOIN {power}_{s - 1} b ON a.j = b.i GROUP BY ALL"))
            out.append((f"{power}_{s}", scaled(f"{power}_{s}r")))
        last = f"{power}_{SQUARINGS}"
        out += [
            (f"{p}w{f}", f"SELECT i AS t, g AS v FROM {last} WHERE j = (SELECT arg_max(i, g) FROM {last} WHERE i = j)"),
            (f"{p}v{f}", f"SELECT t, v / (SELECT sqrt(sum(v * v)) FROM {p}w{f}) * sign((SELECT arg_max(v, abs(v)) FROM {p}w{f})) AS v FROM {p}w{f}"),
            (f"{p}l{f}", f"SELECT sum(a.v * g * b.v) AS l FROM {rest} JOIN {p}v{f} a ON a.t = i JOIN {p}v{f} b ON b.t = j"),
            (f"{p}gram{f}", f"SELECT i, j, g - l * a.v * b.v AS g FROM {rest} JOIN {p}v{f} a ON a.t = i JOIN {p}v{f} b ON b.t = j CROSS JOIN {p}l{f}"),
        ]
    out.append((f"{p}scores", " UNION ALL ".join(f"SELECT t, CAST({f} AS INT) AS k, v * sqrt(l) AS f, l FROM {p}v{f}, {p}l{f}" for f in range(1, k + 1))))
    return out


def loadings(z: str) -> tuple[str, str]:
    return "load", f"SELECT series, k, sum(z * f) / any_value(l) AS l FROM {z} JOIN scores USING (t) GROUP BY series, k"


def var1_path(horizon: int) -> list[tuple[str, str]]:
    """Two factors regressed on a constant and both factors one period before: ``path(h, k, f)``."""
    out = [
        ("sw", "SELECT a.t, a.f AS f1, b.f AS f2 FROM scores a JOIN scores b ON a.t = b.t AND a.k = 1 AND b.k = 2"),
        ("sl", "SELECT *, lag(f1) OVER (ORDER BY t) AS b1, lag(f2) OVER (ORDER BY t) AS b2 FROM sw"),
        ("sm_", """SELECT var_pop(b1) AS s11, var_pop(b2) AS s22, covar_pop(b1, b2) AS s12, covar_pop(b1, f1) AS s1a, covar_pop(b2, f1) AS s2a, covar_pop(b1, f2) AS s1b, covar_pop(b2, f2) AS s2b,
            avg(f1) AS ma, avg(f2) AS mb, avg(b1) AS m1, avg(b2) AS m2 FROM sl WHERE b1 IS NOT NULL"""),
        ("va", "SELECT *, " + ", ".join(f"(s1{y} * s22 - s2{y} * s12) / (s11 * s22 - s12 * s12) AS p1{y}, (s2{y} * s11 - s1{y} * s12) / (s11 * s22 - s12 * s12) AS p2{y}" for y in "ab") + " FROM sm_"),
        ("vc", "SELECT *, " + ", ".join(f"m{y} - p1{y} * m1 - p2{y} * m2 AS c{y}" for y in "ab") + " FROM va"),
        ("st0", "SELECT f1, f2 FROM sw WHERE t = (SELECT max(t) FROM sw)"),
    ]
    out += [(f"st{h}", f"SELECT ca + p1a * f1 + p2a * f2 AS f1, cb + p1b * f1 + p2b * f2 AS f2 FROM st{h - 1}, vc") for h in range(1, horizon + 1)]
    out.append(("path", " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS h, CAST({k} AS INT) AS k, f{k} AS f FROM st{h}" for h in range(1, horizon + 1) for k in (1, 2))))
    return out


def ar1_path(horizon: int) -> list[tuple[str, str]]:
    """Every factor regressed on itself one period before, the slope within 0.99: ``path(h, k, f)``."""
    out = [
        ("sl", "SELECT *, lag(f) OVER (PARTITION BY k ORDER BY t) AS b FROM scores"),
        ("fa", "SELECT k, regr_intercept(f, b) AS c, greatest(least(regr_slope(f, b), 0.99), -0.99) AS phi, arg_max(f, t) AS f_last FROM sl GROUP BY k"),
        ("st0", "SELECT k, f_last AS f FROM fa"),
    ]
    out += [(f"st{h}", f"SELECT k, c + phi * f AS f FROM st{h - 1} JOIN fa USING (k)") for h in range(1, horizon + 1)]
    out.append(("path", " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS h, k, f FROM st{h}" for h in range(1, horizon + 1))))
    return out


def decay_path(horizon: int, persistence: float) -> list[tuple[str, str]]:
    last = "SELECT k, f AS f_last FROM scores WHERE t = (SELECT max(t) FROM scores)"
    return [("fl", last), ("path", f"SELECT CAST(h AS INT) AS h, k, f_last * pow({persistence}, h) AS f FROM fl, (SELECT unnest(range(1, {horizon + 1})) AS h)")]


def forecasts(z: str, all_series: str, horizon: int) -> list[tuple[str, str]]:
    """``fx(series, tcode, h, f)`` for every series of ``all_series(series, tcode)``, NULL for those without loadings."""
    return [
        loadings(z),
        ("fs", f"SELECT series, h, sum(load.l * path.f) * any_value(sd) + any_value(mu) AS f FROM load JOIN path USING (k) JOIN (SELECT DISTINCT series, mu, sd FROM {z}) USING (series) GROUP BY series, h"),
        ("fx", f"SELECT s.series, s.tcode, CAST(hh.h AS INT) AS h, fs.f FROM {all_series} s CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS h) hh LEFT JOIN fs ON fs.series = s.series AND fs.h = hh.h"),
    ]
