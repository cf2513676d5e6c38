"""Date parsing, differences and calendar rules.

Date-times are read as wall-clock times in the session time zone; run with
``spark.sql.session.timeZone=UTC`` so that every day has 24 hours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlens.constants import FULL_REPORT_WEEKDAY

_MICROS_PER_DAY = 86_400_000_000.0


def parse_iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text to date, null for anything else."""
    return F.try_to_date(c, "yyyy-MM-dd")


def parse_dmy(c: Column) -> Column:
    """Day/month/year text to date; years 69-99 without a century are 19xx."""
    short = F.try_to_date(c, "d/M/yy")
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(F.try_to_date(c, "d/M/yyyy"), short)


def parse_stamp(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to timestamp, null for anything else."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def day_difference(later: Column, earlier: Column) -> Column:
    """Days between two date-times as a double."""
    return (_micros(later) - _micros(earlier)) / F.lit(_MICROS_PER_DAY)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete days between two date-times."""
    return F.floor(day_difference(later, earlier))


def weekday(c: Column) -> Column:
    """Day of the week with Sunday = 1."""
    return F.dayofweek(c)


def is_report_day(c: Column, day: int = FULL_REPORT_WEEKDAY) -> Column:
    """True on the weekday of the full report."""
    return weekday(c) == F.lit(day)


def epiweek(c: Column) -> Column:
    """Epidemiological week number (weeks start on Sunday).

    A week belongs to the year that holds its Wednesday.
    """
    day = F.to_date(c)
    wednesday = F.date_add(day, F.lit(4) - F.dayofweek(day))
    return (F.floor((F.dayofyear(wednesday) - 1) / 7) + 1).cast("int")
