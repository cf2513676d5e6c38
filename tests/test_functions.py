"""Null, text, number and date rules on hand-written values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardlens import functions as fn


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_title_case_breaks_at_marks_but_not_inside_words(spark):
    rows = [("CONTACTO/GOTAS Y AÉREO",), ("d'aria p.ej x_y 2a a-b",), (None,)]
    assert values(spark, rows, "x string", fn.title_case(F.col("x"))) == [
        "Contacto/Gotas Y Aéreo",
        "D'aria P.ej X_y 2a A-B",
        None,
    ]


def test_sentence_case(spark):
    rows = [("NOSOCOMIAL",), ("UNO. DOS! TRES",), ("  (ÁRBOL verde)",), (None,)]
    assert values(spark, rows, "x string", fn.sentence_case(F.col("x"))) == [
        "Nosocomial",
        "Uno. Dos! Tres",
        "  (Árbol verde)",
        None,
    ]


def test_pattern_tests_differ_on_null(spark):
    df = spark.createDataFrame([("Virus A",), ("otro",), (None,)], "x string")
    assert df.filter(fn.detect(F.col("x"), "Virus", negate=True)).count() == 1
    assert df.filter(~fn.contains_pattern(F.col("x"), "Virus")).count() == 2
    assert df.filter(fn.contains_pattern(F.col("x"), "virus", ignore_case=True)).count() == 1
    assert df.filter(fn.starts_with_pattern(F.col("x"), "Vi|ot")).count() == 2
    assert df.filter(fn.ends_with(F.col("x"), "A")).count() == 1


def test_first_digit_and_paste(spark):
    rows = [("cama3b4", "a"), ("cama", None)]
    assert values(spark, rows, "x string, y string", fn.first_digit(F.col("x"))) == ["3", None]
    assert values(spark, rows, "x string, y string", fn.last_character(F.col("x"))) == ["4", "a"]
    assert values(spark, rows, "x string, y string", fn.paste(F.col("x"), F.col("y"))) == [
        "cama3b4 a",
        "cama NA",
    ]
    assert values(spark, rows, "x string, y string", fn.paste_tight(F.col("y"), F.lit("¹"))) == [
        "a¹",
        "NA¹",
    ]
    assert values(spark, [("a / b",)], "x string", fn.replace_all(F.col("x"), "/ ", "/\n")) == [
        "a /\n b".replace("\n ", "\n")
    ]


def test_null_choice_gives_null_for_null_test(spark):
    rows = [(True,), (False,), (None,)]
    got = values(spark, rows, "t boolean", fn.if_na(F.col("t"), F.lit("y"), F.lit("n")))
    assert got == ["y", "n", None]


def test_value_or_null(spark):
    df = spark.createDataFrame([("DUDOSO",), ("SI",), (None,)], "x string")
    assert df.filter(fn.is_value_or_null(F.col("x"), "DUDOSO")).count() == 2


def test_ratio_by_zero_is_null(spark):
    rows = [(1, 4), (1, 0), (0, 0)]
    got = values(spark, rows, "a int, b int", fn.ratio(F.col("a"), F.col("b"), 100.0))
    assert got == [25.0, None, None]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, None), (None, 3)], "k string, v int")
    row = df.agg(
        fn.count_distinct_with_null(F.col("k")).alias("d"),
        fn.max_or_null(F.col("v")).alias("m"),
        fn.sum_or_zero(F.col("v")).alias("s"),
    ).first()
    assert (row.d, row.m, row.s) == (2, None, 6)
    none = df.filter("false").agg(fn.sum_or_zero(F.col("v")).alias("s")).first()
    assert none.s == 0


@pytest.mark.parametrize(
    "x, digits, expected",
    [(0.125, 2, 0.12), (2.675, 2, 2.67), (0.375, 2, 0.38), (2.5, 0, 2.0), (-1.005, 2, -1.0),
     (41.3, 2, 41.3), (0.0, 2, 0.0)],
)
def test_round_half_even(spark, x, digits, expected):
    assert values(spark, [(x,)], "x double", fn.round_half_even(F.col("x"), digits)) == [expected]


def test_format_number(spark):
    rows = [(7.0,), (1234.5678,), (0.125,), (None,)]
    assert values(spark, rows, "x double", fn.format_number(F.col("x"))) == [" 7", "1235", " 0", "NA"]
    assert values(spark, rows, "x double", fn.format_number(F.col("x"), "percent", 2)) == [
        "7.00%",
        "1234.57%",
        "0.12%",
        "NA%",
    ]


def test_backfill_from_rate(spark):
    rows = [(5, 9.0), (None, 2.0), (None, None)]
    got = values(spark, rows, "n int, r double", fn.backfill_from_rate(F.col("n"), F.col("r")))
    assert got == [5.0, pytest.approx(19.46), None]


def test_parsing(spark):
    rows = [("2022-07-26",), ("2022-07-26 10:00:00",), ("no",), (None,)]
    assert values(spark, rows, "x string", fn.parse_iso_date(F.col("x"))) == [
        date(2022, 7, 26),
        None,
        None,
        None,
    ]
    assert values(spark, rows, "x string", fn.parse_stamp(F.col("x")))[1] == datetime(
        2022, 7, 26, 10
    )
    rows = [("26/07/22",), ("1/3/1999",), ("01/03/75",), ("x",)]
    assert values(spark, rows, "x string", fn.parse_dmy(F.col("x"))) == [
        date(2022, 7, 26),
        date(1999, 3, 1),
        date(1975, 3, 1),
        None,
    ]


def test_day_differences(spark):
    rows = [(datetime(2022, 1, 3, 12), datetime(2022, 1, 1))]
    schema = "a timestamp, b timestamp"
    assert values(spark, rows, schema, fn.day_difference(F.col("a"), F.col("b"))) == [2.5]
    assert values(spark, rows, schema, fn.whole_days(F.col("a"), F.col("b"))) == [2]


def test_week_numbers(spark):
    # weeks start on Sunday and belong to the year of their Wednesday
    rows = [(date(2022, 1, 1),), (date(2022, 1, 2),), (date(2020, 12, 31),), (date(2021, 1, 3),)]
    assert values(spark, rows, "d date", fn.epiweek(F.col("d"))) == [52, 1, 53, 1]
    assert values(spark, [(date(2026, 12, 2),)], "d date", fn.weekday(F.col("d"))) == [4]
    assert values(spark, [(date(2026, 12, 2),)], "d date", fn.is_report_day(F.col("d"))) == [True]
