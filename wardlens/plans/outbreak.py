"""COVID situation: cases, subsets, state of the day, history and review lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.constants import (
    ACTIVE,
    AXIS_MARGIN_DAYS,
    CAUSE_DOUBTFUL,
    CAUSE_YES,
    COVID_ORGANISM,
    CRITICAL_WARDS,
    DEATH,
    FIRST_ADMISSION,
    INACTIVE,
    KEY,
    LONG_POSITIVE_DAYS,
    MECHANISMS_WITHOUT_AMPC,
    SLOT_PREFIXES,
    SLOT_PREFIXES_WITH_TIMES,
    VALID_STATUS,
)
from wardlens.functions import is_value_or_null, max_or_null, sentence_case, title_case
from wardlens.operators.columns import containing
from wardlens.operators.keys import upsert_by_date
from wardlens.operators.reshape import measures_long
from wardlens.operators.slots import organism_rows, slot_columns_used
from wardlens.sources.tables import prune_pages

CASE_COLUMNS = (
    "aSIP",
    "aNHC",
    "INGRESO",
    "estadoActual",
    "plantaActual",
    "camaActual",
    "tipoAislamiento",
    "origenInfeccion",
    "fechaAislamiento",
    "fechaRetirada",
    "motivoRetirada",
    "fechaAlta",
    "enfermeraActual",
    "ingresoPorCovid",
)


def _covid_rows(slots: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Rows of the bare COVID organism, in any slot state."""
    rows = organism_rows(
        slots, carry, active_only=False, mechanisms=MECHANISMS_WITHOUT_AMPC, keep_state=True
    )
    return rows.filter(F.col("microorganismo") == COVID_ORGANISM)


def covid_cases(pages: Mapping[str, DataFrame]) -> DataFrame:
    """Valid records with the bare COVID organism, in any slot state.

    Which rows are cases shows on the page with the slots alone, so the organism is tested there
    first; only the keys of cases meet the other pages, of which the first must have them as valid.
    """
    slots = [name for name, page in pages.items() if slot_columns_used(page, SLOT_PREFIXES)]
    if len(slots) != 1:
        raise ValueError(f"the slots must be on one page, not on {slots}")
    page = pages[slots[0]]
    first, *others = [p.drop(*slot_columns_used(p, SLOT_PREFIXES_WITH_TIMES)) for p in pages.values()]
    times = containing(first, "Time")
    valid = first.filter(F.col("RECSTATUS") == VALID_STATUS)
    wanted = {"_": valid} | {str(i): p for i, p in enumerate(others)}
    found = _covid_rows(page.select(KEY, *slot_columns_used(page, SLOT_PREFIXES_WITH_TIMES)), [KEY])
    cut = prune_pages(wanted, [*times, *CASE_COLUMNS])
    cases = found.join(cut.pop("_"), KEY)
    for rest in cut.values():
        cases = cases.join(rest, KEY, "left")
    carried = [KEY, *times, *CASE_COLUMNS]
    tidy = {
        "tipoAislamiento": title_case(F.col("tipoAislamiento")),
        "origenInfeccion": sentence_case(F.col("origenInfeccion")),
    }
    return cases.withColumns(tidy).select(*carried, *found.columns[1:])


def newest_first(cases: DataFrame) -> DataFrame:
    """Cases by last change, the newest first."""
    return cases.orderBy(F.desc_nulls_last("LastSaveTime"))


def _admitted() -> Column:
    return (F.col("estadoActual") == ACTIVE) & (F.col("estadoAislamiento") == ACTIVE)


def wall_clock(moment: datetime) -> Column:
    """A moment as a timestamp of the session's time zone, whatever the zone of this process.

    A naive time is taken as it stands; an aware one is first turned to UTC, the session's zone.
    """
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(" ")).cast("timestamp")


def case_tests(cutoff: datetime) -> Mapping[str, Column]:
    """The subsets of cases by name; a case may belong to several."""
    since = wall_clock(cutoff)
    admitted = _admitted()
    closed = (F.col("fechaInactivacion").cast("timestamp") > since) & (
        F.col("estadoAislamiento") == INACTIVE
    )
    reason, cause = F.col("motivoRetirada"), F.col("ingresoPorCovid")
    return {
        "total_ingresados": admitted,
        "total_criticos": admitted & F.col("plantaActual").isin(*CRITICAL_WARDS),
        "casos_nuevos": (F.col("fechaActivacion").cast("timestamp") > since)
        & admitted
        & (F.col("INGRESO") == FIRST_ADMISSION),
        "altas": closed & (reason != DEATH),
        "exitus": closed & (reason == DEATH) & (cause == CAUSE_YES),
    }


def case_subset(cases: DataFrame, name: str, cutoff: datetime) -> DataFrame:
    """The cases of one subset."""
    return cases.filter(case_tests(cutoff)[name])


def case_subsets(cases: DataFrame, cutoff: datetime) -> DataFrame:
    """Every case once per subset it belongs to, named in ``grupo``; one pass."""
    labels = [F.when(test, F.lit(name)) for name, test in case_tests(cutoff).items()]
    marked = cases.select(F.explode(F.array(*labels)).alias("grupo"), "*")
    return marked.filter(F.col("grupo").isNotNull())


def death_details(cases: DataFrame, cutoff: datetime) -> DataFrame:
    """Patient and day of each death by COVID."""
    return case_subset(cases, "exitus", cutoff).select(
        F.col("aSIP").alias("SIP"),
        F.date_format("fechaInactivacion", "dd-MM-yyyy").alias("fecha_exitus"),
    )


def daily_state(cases: DataFrame, cutoff: datetime, day: date) -> DataFrame:
    """The counts of the day as one row, from one pass over the cases."""
    tests = dict(case_tests(cutoff))
    by_covid = F.col("ingresoPorCovid") == CAUSE_YES
    tests["ingresados_por_covid"] = tests["total_ingresados"] & by_covid
    tests["criticos_por_covid"] = tests["total_criticos"] & by_covid
    counts = cases.agg(*[F.count_if(test).alias(n) for n, test in tests.items()])
    return counts.select(F.lit(day).alias("fecha"), *tests)


def update_history(history: DataFrame, state: DataFrame, day: date) -> DataFrame:
    """History with the row of the day added or replaced."""
    return upsert_by_date(history, state, day)


def admitted_per_ward(cases: DataFrame) -> DataFrame:
    return (
        cases.filter(_admitted())
        .groupBy(F.col("plantaActual").alias("planta"))
        .agg(F.count("*").alias("n_ingresados"))
    )


def doubtful_cause(cases: DataFrame) -> DataFrame:
    """Admitted cases whose cause is doubtful or missing."""
    cause = F.col("ingresoPorCovid")
    return cases.filter(_admitted() & is_value_or_null(cause, CAUSE_DOUBTFUL)).select(
        F.col("aSIP").alias("SIP"),
        F.col("aNHC").alias("NHC"),
        F.col("camaActual").alias("Cama"),
        cause.alias("IngresoPorCovid"),
    )


def long_positive(cases: DataFrame, day: date, days: int = LONG_POSITIVE_DAYS) -> DataFrame:
    """Admitted cases sampled at least ``days`` days ago, by bed."""
    waited = F.datediff(F.lit(day), F.col("fechaMuestra"))
    return (
        cases.filter(_admitted() & (waited >= days))
        .select(
            F.col("aSIP").alias("SIP"),
            F.col("aNHC").alias("NHC"),
            F.col("camaActual").alias("Cama"),
            F.col("ingresoPorCovid").alias("IngresoPorCovid"),
            waited.alias("dias_positivo"),
        )
        .orderBy(F.asc_nulls_last("Cama"))
    )


def occupancy_series(history: DataFrame, start: date | None = None) -> DataFrame:
    """Admitted and critical patients per day, from a start date if given."""
    rows = history if start is None else history.filter(F.col("fecha") >= F.lit(start))
    return measures_long(rows, ["fecha"], ["total_ingresados", "total_criticos"], "name", "value")


def incidence_series(history: DataFrame, start: date | None = None) -> DataFrame:
    """New cases and deaths per day, from a start date if given."""
    rows = history if start is None else history.filter(F.col("fecha") >= F.lit(start))
    dated = rows.withColumn("fecha", F.to_date("fecha"))
    return measures_long(dated, ["fecha"], ["casos_nuevos", "exitus"], "name", "value")


def axis_end(history: DataFrame, margin: int = AXIS_MARGIN_DAYS) -> DataFrame:
    """Newest date plus a margin, as one row; null when a date is missing."""
    newest = F.to_date(max_or_null(F.col("fecha")))
    return history.agg(F.date_add(newest, margin).alias("fecha_max"))
