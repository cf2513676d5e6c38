"""Report runs over a catalog: tables found and read, report built, printed tables written.

Each run takes the day of the report, so repeating it gives the same tables. ``folder`` is a folder
that all executors share, for what several tables of a report read; ``out`` is where the printed
tables go.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from wardlens.plans import reports
from wardlens.plans.indicators import indicator_names
from wardlens.sources import (
    fetch_optional,
    fetch_table,
    first_with_column,
    list_tables,
    load_snapshot,
    safe_replace,
    table_version,
    write_report,
)

PAGES, HOSPITAL, BEDS = "Vigilancia", "Hospital", "nCamas"
NAMES, RESULTS, HISTORY = "indicadores_variables", "indicadores_resultados", "covid_historico"
_SERIES = (
    "n_aisl_totales", "n_covid", "pa_global", "pa_crit", "pa_hosp", "pa_covid",
    "pa_aisl_nosocomial", "pa_cauris", "pa_carba", "pa_acineto", "pa_cdif",
)
_COUNTS = (
    "total_ingresados", "total_criticos", "casos_nuevos", "altas", "exitus",
    "ingresados_por_covid", "criticos_por_covid",
)


def _schema(key: str, kind, names: Sequence[str], other) -> StructType:
    return StructType([StructField(key, kind), *[StructField(n, other) for n in names]])


def _named(database: str | None, name: str) -> str:
    return f"{database}.{name}" if database else name


def read_pages(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The pages of the form by name, the first one first."""
    found = list_tables(spark, PAGES, database)
    if not found:
        raise ValueError(f"no table named {PAGES}... in {database or 'the current database'}")
    return {name: fetch_table(spark, _named(database, name)) for name in found}


def ward_table(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The hospital table that has bed counts."""
    found = {n: fetch_table(spark, _named(database, n)) for n in list_tables(spark, HOSPITAL, database)}
    wards = first_with_column(found, BEDS)
    if wards is None:
        raise ValueError(f"no table named {HOSPITAL}... has a column {BEDS}")
    return wards


def _written(tables: Mapping[str, DataFrame], out: str) -> None:
    write_report(reports.printed(tables), out)


def run_isolation(
    spark: SparkSession, day: date, out: str, database: str | None = None, folder: str | None = None
) -> None:
    """Isolation map and listings; once a week indicators and trends. Metadata may be missing."""
    metadata = _schema("id_indicador", StringType(), ("indicador", "calculo"), StringType())
    names = fetch_optional(spark, _named(database, NAMES), metadata)
    series = _schema("fecha", DateType(), _SERIES, DoubleType())
    tables = reports.isolation_report(
        read_pages(spark, database),
        ward_table(spark, database),
        indicator_names(names, "id_indicador"),
        fetch_optional(spark, _named(database, RESULTS), series),
        day,
        folder,
    )
    _written(tables, out)


def run_cleaning(
    spark: SparkSession, out: str, database: str | None = None, folder: str | None = None
) -> None:
    _written(reports.cleaning_report(read_pages(spark, database), folder), out)


def run_critical(
    spark: SparkSession, out: str, database: str | None = None, folder: str | None = None
) -> None:
    _written(reports.critical_report(read_pages(spark, database), folder=folder), out)


def run_covid(
    spark: SparkSession,
    cutoff: datetime,
    day: date,
    start: date,
    out: str,
    database: str | None = None,
    folder: str | None = None,
) -> None:
    """The COVID report; the day is added to the stored history, or replaced there.

    If another run has replaced the history meanwhile, this one fails and changes nothing there.
    """
    table = _named(database, HISTORY)
    version = table_version(spark, table)
    before = fetch_optional(spark, table, _schema("fecha", DateType(), _COUNTS, DoubleType()))
    tables = reports.covid_report(
        read_pages(spark, database), before, cutoff, day, start, folder=folder
    )
    _written(tables, out)
    safe_replace(tables["historico"], table, version=version)


def run_merge(
    spark: SparkSession, databases: Sequence[str], out: str, folder: str | None = None
) -> None:
    """Several databases, the newest first, as one: whole records, report and bed movements."""
    snapshots = [load_snapshot(spark, PAGES, name) for name in databases]
    _written(reports.merged_report(snapshots, folder), out)
