"""Column helpers with the null, text, rounding and date rules the reports rely on."""

from wardlens.functions.dates import (
    day_difference,
    epiweek,
    is_report_day,
    parse_dmy,
    parse_iso_date,
    parse_stamp,
    weekday,
    whole_days,
)
from wardlens.functions.nulls import (
    count_distinct_with_null,
    if_na,
    is_value_or_null,
    max_or_null,
    ratio,
    sum_or_zero,
)
from wardlens.functions.numbers import backfill_from_rate, format_number, round_half_even
from wardlens.functions.text import (
    contains_pattern,
    contains_text,
    detect,
    ends_with,
    first_digit,
    last_character,
    paste,
    paste_tight,
    replace_all,
    sentence_case,
    starts_with_pattern,
    title_case,
)

__all__ = [
    "backfill_from_rate",
    "contains_pattern",
    "contains_text",
    "count_distinct_with_null",
    "day_difference",
    "detect",
    "ends_with",
    "epiweek",
    "first_digit",
    "format_number",
    "if_na",
    "is_report_day",
    "is_value_or_null",
    "last_character",
    "max_or_null",
    "parse_dmy",
    "parse_iso_date",
    "parse_stamp",
    "paste",
    "paste_tight",
    "ratio",
    "replace_all",
    "round_half_even",
    "sentence_case",
    "starts_with_pattern",
    "sum_or_zero",
    "title_case",
    "weekday",
    "whole_days",
]
