"""Date scalars: parsing by format list, month keys, future dates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The date formats accepted by each kind of input, in the order they are tried.
FORMATS_BASIC = ("M/d/yyyy", "yyyy-MM-dd", "yyyy/MM/dd")
FORMATS_WIDE = ("M/d/yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "M-d-yyyy")


def parse_date(text: Column, formats: Sequence[str] = FORMATS_BASIC) -> Column:
    """First format that fits this cell, else NULL."""
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in formats])


def parse_date_column(df: DataFrame, text: str, formats: Sequence[str], keys: Sequence[str], out: str = "ds") -> DataFrame:
    """Choose one format per file: the first that parses all of its dates; if none does, parse cell by cell."""
    fits = [F.count(F.try_to_date(F.col(text), fmt)) == F.count(text) for fmt in formats]
    number = F.coalesce(*[F.when(ok, F.lit(i)) for i, ok in enumerate(fits)])
    chosen = df.groupBy(*keys).agg(number.alias("_format"))
    by_format = F.coalesce(*[F.when(F.col("_format") == i, F.try_to_date(F.col(text), fmt)) for i, fmt in enumerate(formats)])
    parsed = F.when(F.col("_format").isNull(), parse_date(F.col(text), formats)).otherwise(by_format)
    return df.join(chosen, list(keys)).withColumn(out, parsed).drop("_format")


def month_key(ds: Column) -> Column:
    return F.date_format(ds, "yyyy-MM")


def unpadded(ds: Column) -> Column:
    """``M/D/YYYY`` without leading zeros."""
    return F.date_format(ds, "M/d/yyyy")


def future_month_start(last: Column, h: Column) -> Column:
    """First day of the ``h``-th month after ``last``."""
    return F.add_months(F.trunc(last, "MM"), h)


def future_same_day(last: Column, h: Column) -> Column:
    """``last`` moved by ``h`` months, keeping the day of the month."""
    return F.add_months(last, h)


def shifted(first: Column, periods: Column, freq: str) -> Column:
    """``first`` moved by a number of periods of the panel's frequency."""
    if freq == "month":
        return F.add_months(first, periods)
    if freq == "day":
        return F.date_add(first, periods)
    if freq == "hour":
        return F.timestamp_add("HOUR", periods, first)
    raise ValueError(f"unknown frequency {freq!r}")


def future(last: Column, h: Column, freq: str = "month") -> Column:
    """The ``h``-th period after ``last``; for months its first day."""
    return future_month_start(last, h) if freq == "month" else shifted(last, h, freq)


def horizon_label(h: Column) -> Column:
    return F.when(h == 1, F.lit("1 Month")).otherwise(F.concat(h.cast("string"), F.lit(" Months")))
