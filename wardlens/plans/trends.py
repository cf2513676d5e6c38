"""Series behind the trend charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.constants import MDR_SERIES_LABELS, PRESSURE_SERIES
from wardlens.functions import backfill_from_rate, epiweek
from wardlens.operators.reshape import measures_long
from wardlens.operators.series import smooth, smooth_band


def isolation_series(results: DataFrame) -> DataFrame:
    """Total and COVID isolations per day, with week and year of each date.

    Where the COVID count is missing it is rebuilt from its percentage.
    """
    return results.select(
        "fecha",
        epiweek(F.col("fecha")).alias("epiweek"),
        F.year("fecha").cast("string").alias("year"),
        "n_aisl_totales",
        backfill_from_rate(F.col("n_covid"), F.col("pa_covid")).alias("n_covid"),
    ).orderBy(F.asc_nulls_last("fecha"))


def pressure_series(results: DataFrame) -> DataFrame:
    """Global, critical, ward and COVID pressure, long."""
    return measures_long(results, ["fecha"], list(PRESSURE_SERIES), "pa_name", "pa_value")


def resistant_series(results: DataFrame) -> DataFrame:
    """Pressure of the four resistant organisms, long, each with its label.

    Labels belong to the series names in alphabetical order.
    """
    names = sorted(MDR_SERIES_LABELS)
    long = measures_long(results, ["fecha"], names, "pa_mr_name", "pa_mr_value")
    label = F.coalesce(
        *[F.when(F.col("pa_mr_name") == n, F.lit(MDR_SERIES_LABELS[n])) for n in names]
    )
    return long.withColumn("etiqueta", label)


def series_names(long: DataFrame, name: str) -> DataFrame:
    """Sorted distinct series names."""
    return long.select(name).distinct().orderBy(F.asc_nulls_last(name))


def _days(results: DataFrame, measures: list[str]) -> DataFrame:
    long = measures_long(results, ["fecha"], measures, "serie", "valor")
    return long.withColumn("dia", F.unix_date(F.to_date("fecha")))


def smooth_series(results: DataFrame, measures: list[str]) -> DataFrame:
    """Smoothed curve of each measure over the days."""
    return smooth(_days(results, measures), "serie", "dia", "valor")


def smooth_series_band(results: DataFrame, measures: list[str]) -> DataFrame:
    """Smoothed curve of each measure with its band of 95 %."""
    return smooth_band(_days(results, measures), "serie", "dia", "valor")
