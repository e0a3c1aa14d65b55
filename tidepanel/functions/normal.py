"""Least squares as Spark expressions: sums of products of a group, and elimination on small arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of a regressor's own variation means that the regressors do not tell the coefficients.
SINGULAR = 1e-9


def product_sums(columns: Sequence[str], prefix: str = "_g") -> list[Column]:
    """Aggregates: the sums of products of every two of the SQL expressions ``columns``."""
    return [F.expr(f"sum(({a}) * ({b})) AS {prefix}{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]


def gram(size: int, prefix: str = "_g") -> Column:
    """The symmetric matrix of ``product_sums`` as an array of rows."""
    row = lambda i: ", ".join(f"{prefix}{min(i, j)}_{max(i, j)}" for j in range(size))
    return F.expr("array(" + ", ".join(f"array({row(i)})" for i in range(size)) + ")")


def equations(matrix: Column, regressors: Column, target: Column) -> Column:
    """Rows of the normal equations of ``regressors`` (an array of positions), the right-hand side at the end of each."""
    place = F.array_append(regressors, target)
    return F.transform(regressors, lambda i: F.transform(place, lambda j: F.get(F.get(matrix, i), j)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def solve(equations_: Column) -> Column:
    """Solution of the equations by Gauss-Jordan elimination, as an array; NULL if they have no single solution."""

    def whole(rows: Column) -> Column:
        def pivot(held: Column, p: Column) -> Column:
            tell = F.abs(F.get(F.get(held, p), p)) > SINGULAR * F.abs(F.get(F.get(rows, p), p))
            lead = F.when(tell, F.get(F.get(held, p), p))
            without = lambda scaled: F.transform(
                held, lambda row, r: F.when(r == p, scaled).otherwise(bound(F.get(row, p), lambda own: F.zip_with(row, scaled, lambda x, y: x - own * y)))
            )
            return bound(bound(lead, lambda by: F.transform(F.get(held, p), lambda v: v / by)), without)

        steps = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.aggregate(steps, rows, pivot), lambda row: F.element_at(row, -1))

    finite = lambda found: F.when(F.forall(found, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), found)
    return bound(bound(equations_, whole), finite)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the longer array's rest counts as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
