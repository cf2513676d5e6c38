"""Null-aware choices and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_na(test: Column, yes: Column, no: Column) -> Column:
    """``when(test, yes).otherwise(no)`` that is null where the test is null."""
    return F.when(test, yes).when(~test, no)


def is_value_or_null(c: Column, value: object) -> Column:
    return (c == F.lit(value)) | c.isNull()


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Quotient as double; null when the denominator is zero (never infinite)."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if scale == 1.0 else quotient * F.lit(float(scale))


def sum_or_zero(c: Column) -> Column:
    """Sum over the non-null values; zero when there are none."""
    return F.coalesce(F.sum(c), F.lit(0))


def max_or_null(c: Column) -> Column:
    """Maximum that is null as soon as one value is null."""
    return F.when(F.count_if(c.isNull()) == 0, F.max(c))


def count_distinct_with_null(c: Column) -> Column:
    """Distinct count in which null is one more value."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
