"""Isolation-pressure indicators: one row of metrics and its printed table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.constants import (
    AREA_CRITICAL,
    AREA_WARD,
    DROPLETS,
    NOSOCOMIAL,
    PERCENT_3_PATTERN,
)
from wardlens.functions import (
    contains_pattern,
    contains_text,
    format_number,
    ratio,
    starts_with_pattern,
    sum_or_zero,
)
from wardlens.operators.keys import number_rows
from wardlens.operators.reshape import metrics_long

ORGANISM = "microorganismo"

# counts of rows whose organism contains a text
ORGANISM_COUNTS = {
    "n_covid": "SARS-CoV-2",
    "n_cauris": "Candida auris",
    "n_cdif": "difficile",
    "n_acineto": "Acineto",
}
# percentages: metric -> (count, denominator)
PERCENTAGES = {
    "pa_global": ("n_aisl_totales", "total_camas"),
    "pa_crit": ("n_aisl_crit", "total_camas_crit"),
    "pa_hosp": ("n_aisl_hosp", "total_camas_hosp"),
    "pa_acineto": ("n_acineto", "total_camas"),
    "pa_aisl_nosocomial": ("n_aisl_nosocomial", "total_camas"),
    "pa_carba": ("n_carba", "total_camas"),
    "pa_cauris": ("n_cauris", "total_camas"),
    "pa_cdif": ("n_cdif", "total_camas"),
    "pa_covid": ("n_covid", "total_camas"),
    "pa_virus_resp": ("n_virus_resp", "total_camas"),
    "ta_aisl_nosocomial": ("n_aisl_nosocomial", "n_aisl_totales"),
    "ta_virus_resp": ("n_virus_resp", "n_aisl_totales"),
}
COUNTS = (
    "n_aisl_totales",
    "n_aisl_hosp",
    "n_aisl_crit",
    "n_aisl_nosocomial",
    "total_camas",
    "total_camas_hosp",
    "total_camas_crit",
    "n_virus_resp_total",
    "n_virus_resp",
    "n_covid",
    "n_carba",
    "n_cauris",
    "n_cdif",
    "n_acineto",
)
METRICS = (
    *COUNTS,
    *[m for m in PERCENTAGES if m.startswith("pa_")],
    "razon_covid_resp",
    *[m for m in PERCENTAGES if m.startswith("ta_")],
)


def _row_counts() -> Mapping[str, Column]:
    organism = F.col(ORGANISM)
    droplet_virus = contains_text(F.col("tipoAislamiento"), DROPLETS) & contains_text(
        organism, "Virus"
    )
    tests = {n: contains_text(organism, text) for n, text in ORGANISM_COUNTS.items()}
    tests["n_carba"] = contains_pattern(organism, "carbapenemasa", ignore_case=True)
    tests["n_virus_resp_total"] = droplet_virus
    tests["n_virus_resp"] = droplet_virus & ~contains_text(organism, "SARS-CoV-2")
    tests["n_aisl_nosocomial"] = F.col("origenInfeccion") == NOSOCOMIAL
    return tests


def ward_beds(wards: DataFrame) -> DataFrame:
    """Beds in the whole hospital, its wards and its critical areas, as one row."""
    area, beds = F.col("areaHospital"), F.col("nCamas")
    return wards.agg(
        sum_or_zero(beds).cast("long").alias("total_camas"),
        sum_or_zero(F.when(area == AREA_WARD, beds)).cast("long").alias("total_camas_hosp"),
        sum_or_zero(F.when(area == AREA_CRITICAL, beds)).cast("long").alias("total_camas_crit"),
    )


def isolation_counts(ward_rows: DataFrame, wards: DataFrame) -> DataFrame:
    """All counts over the ward table as one row, from one pass over it.

    Rows are first folded per bed and ward, which starts before the shuffle, so the
    ward table is joined to the folded rows only and a full ward is no hot key.
    Then they are folded per bed: counting beds is counting groups, and a missing
    bed is a group like any other.
    """
    tests = _row_counts()
    area = F.col("areaHospital")
    folded = ward_rows.groupBy("camaActual", "plantaActual").agg(
        *[F.count_if(test).alias(n) for n, test in tests.items()]
    )
    with_area = folded.join(wards.select("plantaActual", "areaHospital"), "plantaActual", "left")
    per_bed = with_area.groupBy("camaActual").agg(
        F.bool_or(area == AREA_WARD).alias("_ward"),
        F.bool_or(area == AREA_CRITICAL).alias("_critical"),
        *[F.sum(n).alias(n) for n in tests],
    )
    return per_bed.agg(
        F.count("*").alias("n_aisl_totales"),
        F.count_if("_ward").alias("n_aisl_hosp"),
        F.count_if("_critical").alias("n_aisl_crit"),
        *[sum_or_zero(F.col(n)).alias(n) for n in tests],
    )


def indicators(ward_rows: DataFrame, wards: DataFrame, day: date) -> DataFrame:
    """The metrics of one day as one row.

    The two one-row aggregates are stacked and folded, so no join is needed. A
    ratio with a zero denominator is null.
    """
    parts = isolation_counts(ward_rows, wards).unionByName(
        ward_beds(wards), allowMissingColumns=True
    )
    counts = parts.agg(*[F.max(c).alias(c) for c in COUNTS])
    percents = {
        name: ratio(F.col(top), F.col(bottom), 100.0) for name, (top, bottom) in PERCENTAGES.items()
    }
    derived = percents | {"razon_covid_resp": ratio(F.col("n_covid"), F.col("n_virus_resp"))}
    return counts.select(
        F.lit(day).alias("fecha"),
        *[(derived[m].alias(m) if m in derived else F.col(m)) for m in METRICS],
    )


def indicator_names(metadata: DataFrame, order: str) -> DataFrame:
    """Metadata with its line break in the formula and its row number as ``orderId``."""
    broken = metadata.withColumn("calculo", F.replace("calculo", F.lit("/ "), F.lit("/\n")))
    return number_rows(broken, [order])


def format_indicator(name: Column, value: Column) -> Column:
    """Printed value; the first rule that fits the name decides.

    Names with a multi-resistant organism print as a percentage with three places
    even when they are counts.
    """
    return (
        F.when(contains_pattern(name, PERCENT_3_PATTERN), format_number(value, "percent", 3))
        .when(starts_with_pattern(name, "n_"), format_number(value))
        .when(starts_with_pattern(name, "pa|ta"), format_number(value, "percent", 2))
        .when(starts_with_pattern(name, "razon"), format_number(value, "double", 2))
    )


def indicator_table(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """Name, formula and printed value of each metric that has metadata, in its order."""
    long = metrics_long(metrics, METRICS, "id_indicador", "resultado")
    return (
        long.join(names, "id_indicador")
        .withColumn("resultado", format_indicator(F.col("id_indicador"), F.col("resultado")))
        .orderBy("orderId")
        .select("orderId", "indicador", "calculo", "resultado")
    )


def rows_per_bed_origin(ward_rows: DataFrame) -> DataFrame:
    """Rows and nosocomial rows per bed, with the nosocomial share in percent."""
    origin = F.col("origenInfeccion")
    counts = ward_rows.groupBy("camaActual").agg(
        F.count("*").alias("n_filas"), F.count_if(origin == NOSOCOMIAL).alias("n_nosocomial")
    )
    share = ratio(F.col("n_nosocomial"), F.col("n_filas"), 100.0)
    return counts.withColumn("pct_nosocomial", share)
