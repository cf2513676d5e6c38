"""Whole reports: every table of one report run, by name.

Each takes the pages of the surveillance form and the day of the report, so a run
can be repeated. What several tables of a report share is stored once in ``folder``, which
all executors must share (see :func:`wardlens.sources.durable`); with None it is not stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.constants import CRITICAL_WARDS, FULL_REPORT_WEEKDAY, PRINTED_NAMES
from wardlens.operators.columns import present
from wardlens.operators.keys import snapshot_merge
from wardlens.operators.reshape import drop_empty
from wardlens.operators.series import moving_average
from wardlens.plans import indicators, isolation, movements, outbreak, trends
from wardlens.sources.sinks import durable
from wardlens.sources.tables import join_pages

Tables = dict[str, DataFrame]
Pages = Mapping[str, DataFrame]


def is_full_report(day: date, weekday: int = FULL_REPORT_WEEKDAY) -> bool:
    """Whether the report of a day has its weekly part (Sunday = 1)."""
    return day.isoweekday() % 7 + 1 == weekday


def printed(tables: Mapping[str, DataFrame]) -> Tables:
    """The tables of a report with the columns and names they are printed with.

    Of the isolation map, the classes that never occur are left out; that reads the map once.
    """
    shown = dict(tables)
    if "mapa" in shown:
        shown["mapa"] = drop_empty(shown["mapa"], list(isolation.CLASS_COLUMNS.values()))
    return {
        name: present(df, _names_of(df, PRINTED_NAMES[name])) if name in PRINTED_NAMES else df
        for name, df in shown.items()
    }


def _names_of(df: DataFrame, names: Mapping[str, str]) -> dict[str, str]:
    return {column: name for column, name in names.items() if column in df.columns}


def _ward_rows(pages: Pages, folder: str | None) -> DataFrame:
    rows = isolation.ward_table(isolation.active_records(join_pages(pages)))
    return durable(rows, folder) if folder else rows


def isolation_report(
    pages: Pages,
    wards: DataFrame,
    names: DataFrame,
    results: DataFrame,
    day: date,
    folder: str | None = None,
) -> Tables:
    """Isolation map and ward listings; once a week also indicators and trend series.

    ``names`` is the metadata with its ``orderId``, ``results`` the indicator history.
    """
    rows = _ward_rows(pages, folder)
    tables = {
        "mapa": isolation.sorted_isolation_map(isolation.resistant_list(rows)),
        "criticos": isolation.ward_listing(rows, CRITICAL_WARDS),
        "hospitalizacion": isolation.ward_listing(rows, CRITICAL_WARDS, within=False),
    }
    if is_full_report(day):
        metrics = indicators.indicators(rows, wards, day)
        resistant = ["pa_cauris", "pa_carba", "pa_acineto", "pa_cdif"]
        tables |= {
            "indicadores": indicators.indicator_table(metrics, names),
            "aislamientos": trends.isolation_series(results),
            "presion": trends.pressure_series(results),
            "nosocomial": trends.smooth_series(results, ["pa_aisl_nosocomial"]),
            "resistentes": trends.resistant_series(results),
            "resistentes_suavizado": trends.smooth_series(results, resistant),
        }
    return tables


def cleaning_report(pages: Pages, folder: str | None = None) -> Tables:
    """Beds for double cleaning in critical and in other wards, by bed."""
    beds = isolation.cleaning_list(_ward_rows(pages, folder))
    return {
        area: beds.filter(F.col("area") == area).drop("area").orderBy("Cama")
        for area in ("criticos", "hospitalizacion")
    }


def critical_report(
    pages: Pages, wards: Sequence[str] = CRITICAL_WARDS, folder: str | None = None
) -> Tables:
    """Listing of the critical wards."""
    return {"criticos": isolation.ward_listing(_ward_rows(pages, folder), wards)}


def covid_report(
    pages: Pages,
    history: DataFrame,
    cutoff: datetime,
    day: date,
    start: date,
    n_full: int = 14,
    n_partial: int = 7,
    folder: str | None = None,
) -> Tables:
    """State of the day, lists, the new history and its series from the start and from a day."""
    cases = outbreak.covid_cases(pages)
    cases = durable(cases, folder) if folder else cases
    state = outbreak.daily_state(cases, cutoff, day)
    updated = outbreak.update_history(history, state, day)

    def averaged(since: date | None, n: int) -> DataFrame:
        return moving_average(outbreak.incidence_series(updated, since), "name", "fecha", "value", n)

    return {
        "estado": state,
        "por_planta": outbreak.admitted_per_ward(cases),
        "exitus": outbreak.death_details(cases, cutoff),
        "causa_dudosa": outbreak.doubtful_cause(cases),
        "estancia_prolongada": outbreak.long_positive(cases, day),
        "historico": updated,
        "curva_total": averaged(None, n_full),
        "curva_parcial": averaged(start, n_partial),
        "ingresados_total": outbreak.occupancy_series(updated),
        "ingresados_parcial": outbreak.occupancy_series(updated, start),
        "eje": outbreak.axis_end(updated),
    }


def merged_report(snapshots: Sequence[DataFrame], folder: str | None = None) -> Tables:
    """Merged records of several snapshots (newest first), enriched table and bed movements."""
    merged = snapshot_merge(snapshots)
    merged = durable(merged, folder) if folder else merged
    return {
        "total": merged,
        "informe": isolation.enriched_table(isolation.valid_records(merged)),
        "movimientos": movements.bed_movements(merged),
    }
