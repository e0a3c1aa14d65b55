"""ARMA models of whole fleets by two regressions in Spark sums (Hannan and Rissanen).

1. A long autoregression of each series gives its innovations.
2. The value is regressed on a constant, its own lags and the lags of the innovations.

Lags are window functions over the rows of a series, normal equations are sums per series, and they are solved on small
arrays beside them. The sums of the largest model hold those of all smaller ones, so a grid of orders costs one pass,
and all its models are compared on the same rows. Values are centred and scaled per series before they are multiplied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.normal import bound, dot, equations, gram, product_sums, solve
from tidepanel.panel import KEYS

#: Lags of the long autoregression; a series has at most a quarter of its length.
LONG = 8


def _by_row() -> Window:
    return Window.partitionBy(*KEYS).orderBy("i")


def observations(packed: DataFrame, d: int = 0) -> DataFrame:
    """``(KEYS, i, x)`` of packed series, differenced ``d`` times."""
    rows = packed.select(*KEYS, F.posexplode("y").alias("i", "x"))
    for _ in range(d):
        rows = rows.withColumn("x", F.col("x") - F.lag("x").over(_by_row())).filter("x is not null")
    return rows


def _lags(column: str, name: str, count: int) -> dict[str, Column]:
    return {f"{name}{k}": F.lag(column, k).over(_by_row()) for k in range(1, count + 1)}


def scaled_rows(rows: DataFrame, lags: int, centred: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Values ``z`` of ``(KEYS, i, x)`` with their lags ``_z1``, ..., and ``n``, ``mu``, ``sd`` of the series.

    A series without variation has no ``z``."""
    mu = F.avg("x").over(Window.partitionBy(*KEYS)) if centred else F.lit(0.0)
    sized = rows.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy(*KEYS)), "mu": mu})
    sized = sized.withColumn("sd", F.sqrt(F.avg((F.col("x") - F.col("mu")) ** 2).over(Window.partitionBy(*KEYS))))
    z = (F.col("x") - F.col("mu")) / F.when(F.col("sd") > 1e-12 * F.abs("mu"), F.col("sd"))
    out = sized.withColumns({"z": z, "_row": F.row_number().over(_by_row())}).withColumns(_lags("z", "_z", lags))
    return out.select(*KEYS, "i", "_row", "n", "mu", "sd", "z", *[f"_z{k}" for k in range(1, lags + 1)], *keep)


def _gathered(rows: DataFrame, max_p: int, max_q: int, keep: tuple[str, ...]) -> DataFrame:
    """One row per series with the sums of products and the newest values."""
    columns = ["1.0D", *[f"_z{k}" for k in range(1, max_p + 1)], *[f"_e{k}" for k in range(1, max_q + 1)], "z"]
    past = F.array("z", *[f"_z{k}" for k in range(1, max_p)])
    heard = F.array("e", *[f"_e{k}" for k in range(1, max_q)]) if max_q else F.array().cast("array<double>")
    one = lambda c: F.first(c).alias(c)
    sums = rows.groupBy(*KEYS).agg(
        *product_sums(columns), F.count(F.lit(1)).alias("size"), one("n"), one("mu"), one("sd"), F.max_by(F.struct(past.alias("z"), heard.alias("e")), "_row").alias("newest"), *map(one, keep)
    )
    return sums.select(*KEYS, *keep, "n", "mu", "sd", "size", gram(len(columns)).alias("gram"), "newest")


def lag_moments(rows: DataFrame, max_p: int, skip: str) -> DataFrame:
    """As ``moments`` for lags of z only, over the rows after the first ``skip``."""
    return _gathered(scaled_rows(rows, max_p, keep=(skip,)).filter(F.col("_row") > F.col(skip)), max_p, 0, (skip,))


def innovations(rows: DataFrame, centred: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``scaled_rows`` with their innovations ``e``, and ``m``, the lags of the long autoregression. The first ``m``
    rows have no innovation."""
    m = F.least(F.lit(LONG), F.floor(F.col("n") / 4).cast("int"))
    scaled = scaled_rows(rows, LONG, centred, keep).withColumn("m", m)
    columns = ["1.0D", *[f"_z{k}" for k in range(1, LONG + 1)], "z"]
    sums = scaled.filter("_row > m").groupBy(*KEYS).agg(*product_sums(columns), F.first("m").alias("_m"))
    used = F.when(F.col("_m") >= 0, F.sequence(F.lit(0), F.col("_m")))
    coef = sums.select(*KEYS, solve(equations(gram(LONG + 2), used, F.lit(LONG + 1))).alias("_a"))
    fit = dot(F.col("_a"), F.array(F.lit(1.0), *columns[1:-1]))
    e = F.when((F.col("_row") > F.col("m")) & F.col("_a").isNotNull(), F.col("z") - fit)
    return scaled.join(coef, KEYS).withColumn("e", e).drop("_a")


def moments(rows: DataFrame, max_p: int, max_q: int, skip: str | None = None, centred: bool = True) -> DataFrame:
    """One row per series with ``gram``, the sums of products of 1, ``max_p`` lags of z, ``max_q`` lags of e, and z over
    the rows after the first ``m + skip``, their number ``size``, and the newest values and innovations, newest first.

    A series that has no such row is left out. ``skip`` names a column of ``rows`` that is the same in all rows of a series; it defaults to the most lags."""
    after = F.col("m") + (F.lit(max(max_p, max_q)) if skip is None else F.col(skip))
    keep = () if skip is None else (skip,)
    if max_p > LONG:
        raise ValueError(f"at most {LONG} lags")
    lagged = innovations(rows, centred, keep).withColumns(_lags("e", "_e", max_q))
    return _gathered(lagged.filter(F.col("_row") > after), max_p, max_q, keep)


def _stationary(a: Column, p: int) -> Column:
    """Whether an autoregression with the ``p`` coefficients ``a`` dies out: every reflection coefficient of the
    step-down recursion is within (-1, 1). Zeros at the end do not matter."""
    if not p:
        return F.lit(True)
    last = F.get(a, F.lit(p - 1))
    shorter = F.transform(F.slice(a, 1, p - 1), lambda v, k: F.try_divide(v + last * F.get(a, p - 2 - k), 1 - last * last))
    within = F.abs(last) < 0.999
    return within if p == 1 else within & bound(shorter, lambda less: _stationary(less, p - 1))


def with_model(sums: DataFrame, p: Column, q: Column, max_p: int, horizon: int, const: bool = True, damped: bool = True) -> DataFrame:
    """Append the struct ``model`` (aic, path of z) of order ``p`` and ``q`` to rows of ``moments`` of ``max_p`` lags.

    ``model`` is NULL where the equations have no single solution, there are not more rows than coefficients, or, if
    ``damped``, the autoregression does not die out.
    """
    lead = 1 if const else 0
    none = F.array().cast("array<int>")
    upto = lambda first, count: F.when(count > 0, F.sequence(F.lit(first), first + count - 1)).otherwise(none)
    used = F.concat(F.array(F.lit(0)) if const else none, upto(1, p), upto(1 + max_p, q))
    target = F.size("gram") - 1
    last = F.get("gram", target)
    solved = sums.withColumns({"_used": used, "_p": p, "_q": q}).withColumn("_c", solve(equations(F.col("gram"), F.col("_used"), target)))
    own = [F.when(F.col("_p") >= k, F.get("_c", F.lit(lead + k - 1))).otherwise(0.0) for k in range(1, max_p + 1)]
    solved = solved.withColumns({
        "_rss": F.get(last, target) - dot(F.col("_c"), F.transform("_used", lambda i: F.get(last, i))),
        "_a": F.array(*own) if own else F.array().cast("array<double>"),
        "_b": F.slice("_c", lead + F.col("_p") + 1, F.col("_q")),
    })
    count = F.size("_used")
    fine = F.col("_c").isNotNull() & (F.col("size") > count + 1) & (F.col("_rss") > 1e-12 * F.col("size"))
    if damped:
        fine = fine & _stationary(F.col("_a"), max_p)
    aic = F.col("size") * (F.log(F.col("_rss") / F.col("size") * F.col("sd") * F.col("sd")) + math.log(2 * math.pi) + 1) + 2 * (count + 1)
    constant = F.get("_c", F.lit(0)) if const else F.lit(0.0)

    def step(past: Column, h: Column) -> Column:
        """``past`` has the newest value first; an innovation after the last row is 0."""
        heard = dot(F.slice("_b", h, F.greatest(F.col("_q") - h + 1, F.lit(0))), F.col("newest.e"))
        return F.concat(F.array(constant + dot(F.col("_a"), past) + heard), past)

    # before the first step the newest values are the past; the path is what stands before them at the end
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("newest.z"), step)
    path = F.reverse(F.slice(whole, 1, horizon))
    return solved.withColumn("model", F.when(fine, F.struct(aic.alias("aic"), path.alias("path")))).drop("_used", "_p", "_q", "_c", "_rss", "_a", "_b")
