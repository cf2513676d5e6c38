"""Rounding and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlens.constants import BEDS_PER_PERCENT


def round_half_even(c: Column, digits: int) -> Column:
    """Round to the nearer of the two ``digits``-place neighbours, the even one on a tie.

    The distance is measured on the doubles themselves, so 2.675 (stored as a
    little less) goes to 2.67 and 0.125 (a true tie) to 0.12.
    """
    scale = F.lit(float(10**digits))
    x = c.cast("double")
    steps = F.floor(x * scale)
    low, high = steps / scale, F.ceil(x * scale) / scale
    down, up = x - low, high - x
    take_low = (down < up) | ((down == up) & (steps % 2 == 0))
    return F.when(take_low, low).when(~take_low, high)


def format_number(c: Column, kind: str = "double", decimals: int = 0) -> Column:
    """Fixed-point text at least two characters wide, ``%`` added for ``kind="percent"``.

    No thousands separators; a null prints as ``NA``.
    """
    text = F.when(c.isNull(), F.lit("NA")).otherwise(
        F.format_string(f"%2.{decimals}f", round_half_even(c, decimals))
    )
    return F.concat(text, F.lit("%")) if kind == "percent" else text


def backfill_from_rate(count: Column, rate: Column, beds: float = BEDS_PER_PERCENT) -> Column:
    """The count, or where it is missing the count that the percentage stands for."""
    return F.coalesce(count.cast("double"), rate * F.lit(beds))
