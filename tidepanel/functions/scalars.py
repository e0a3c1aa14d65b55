"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE_SUFFIX = "_value"


def number(text: Column) -> Column:
    """Text to double; anything unreadable, NaN included, is NULL."""
    return F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """Round, with -0.0 turned into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, VALUE_SUFFIX + "$", "")


def add_suffix(name: Column) -> Column:
    return F.when(name.endswith(VALUE_SUFFIX), name).otherwise(F.concat(name, F.lit(VALUE_SUFFIX)))


def one_decimal(c: Column) -> Column:
    """One decimal of the exact binary value, half to even, without thousands separators."""
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))


def range_label(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), one_decimal(lo), F.lit(", "), one_decimal(hi), F.lit("]"))


def safe_log(v: Column) -> Column:
    return F.when(v > 0, F.log(v))


def pct_of(change: Column, base: Column) -> Column:
    """Change in percent of the size of ``base``; NULL for a zero base."""
    return F.try_divide(change, F.abs(base)) * 100


def trend_label(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), F.lit("N/A"))
        .when(pct > 1, F.lit("↑ Up"))
        .when(pct < -1, F.lit("↓ Down"))
        .otherwise(F.lit("→ Flat"))
    )


def correlation(x: Column, y: Column) -> Column:
    """Correlation of the aggregated pairs; NULL for a constant side instead of an error."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(F.lit(1)) > 1) & (vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)))
