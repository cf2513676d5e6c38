"""Isolated patients by ward: cohort, ward table, resistant organisms, cross table, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlens.constants import (
    ACTIVE,
    CLASS_RULES,
    CLASSES,
    CLEANING_AURIS,
    CLEANING_DIFFICILE,
    CRITICAL_WARD_PATTERN,
    DAYS_PER_YEAR,
    KEY,
    MDR_PATTERNS,
    MECHANISMS,
    TOTAL_LABEL,
    VALID_STATUS,
    VIRUS_PATTERN,
)
from wardlens.functions import (
    day_difference,
    detect,
    paste_tight,
    round_half_even,
    sentence_case,
    title_case,
    whole_days,
)
from wardlens.operators.reshape import (
    add_row_total,
    add_total_row,
    class_counts,
    empty_if_zero,
)
from wardlens.operators.slots import organism_rows, slot_columns_used

WARD, BED, PATIENT, ORGANISM = "plantaActual", "camaActual", "NHC", "microorganismo"

WARD_TABLE_COLUMNS = (
    "plantaActual",
    "aNHC",
    "camaActual",
    "motivoAislamiento",
    "tipoAislamiento",
    "origenInfeccion",
)
RISK_FACTORS = (
    "cvc",
    "cvp",
    "cirugia",
    "diabetes",
    "inmunodef",
    "ventilacionMecanica",
    "neo",
    "sondaUrinaria",
)

# class label -> column name of the cross table
CLASS_COLUMNS = {c: c.lower().replace(". ", "_").replace(" ", "_") for c in CLASSES}


def valid_records(wide: DataFrame) -> DataFrame:
    """Records that are not deleted."""
    return wide.filter(F.col("RECSTATUS") == VALID_STATUS)


def active_records(wide: DataFrame) -> DataFrame:
    """Valid, active records of a named patient."""
    return valid_records(wide).filter((F.col("estadoActual") == ACTIVE) & F.col("nombre").isNotNull())


def _tidy_texts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "tipoAislamiento": title_case(F.col("tipoAislamiento")),
            "origenInfeccion": sentence_case(F.col("origenInfeccion")),
            "motivoAislamiento": title_case(F.col("motivoAislamiento")),
        }
    ).withColumnRenamed("aNHC", PATIENT)


def ward_table(active: DataFrame) -> DataFrame:
    """One row per active record and organism, with the texts tidied.

    Keeps ``GlobalRecordId`` and ``slot``: they are the row order of every
    operator that later keeps a first row.
    """
    records = active.select(KEY, *WARD_TABLE_COLUMNS, *slot_columns_used(active))
    carry = [KEY, *(PATIENT if c == "aNHC" else c for c in WARD_TABLE_COLUMNS)]
    return organism_rows(_tidy_texts(records), carry, keep_empty=True)


def enriched_table(valid: DataFrame) -> DataFrame:
    """Ward table of all valid records with risk factors, age and isolation days."""
    dates = ("fechaIngreso1", "fechaAislamiento", "fechaRetirada")
    records = valid.select(
        KEY,
        *WARD_TABLE_COLUMNS,
        *RISK_FACTORS,
        "sexo",
        *dates,
        "fechaNacimiento",
        *slot_columns_used(valid),
    ).withColumns(
        {
            "edad_al_ingreso": round_half_even(
                day_difference(F.col("fechaIngreso1"), F.col("fechaNacimiento")) / DAYS_PER_YEAR, 2
            ),
            "dias_aislado": whole_days(F.col("fechaRetirada"), F.col("fechaAislamiento")),
        }
    )
    carry = [
        KEY,
        *(PATIENT if c == "aNHC" else c for c in WARD_TABLE_COLUMNS),
        *RISK_FACTORS,
        "sexo",
        *dates,
        "edad_al_ingreso",
        "dias_aislado",
    ]
    return organism_rows(
        _tidy_texts(records),
        carry,
        active_only=False,
        mechanisms=MECHANISMS,
        keep_mechanism=True,
        keep_empty=True,
    )


def resistant_list(ward_rows: DataFrame, patterns: Sequence[str] = MDR_PATTERNS) -> DataFrame:
    """Rows of resistant or watch-listed organisms; viruses and empty rows drop out."""
    organism = F.col(ORGANISM)
    virus = detect(organism, VIRUS_PATTERN, negate=True)
    return ward_rows.filter(virus & detect(organism, "|".join(patterns)))


def report_class(organism: Column) -> Column:
    """Class of an organism, first rule that holds; null for one no rule covers."""
    return F.coalesce(*[F.when(organism.rlike(p), F.lit(c)) for p, c in CLASS_RULES])


def resistant_classes(resistant: DataFrame) -> DataFrame:
    """Rows per report class; organisms without a class count as ``NA``."""
    cls = F.coalesce(report_class(F.col(ORGANISM)), F.lit("NA"))
    return resistant.groupBy(cls.alias("clase")).agg(F.count("*").alias("n"))


def patients_per_ward(resistant: DataFrame) -> DataFrame:
    """Patients per ward, each counted once in the ward of their first row.

    The first row's ward is a plain minimum that combines before the shuffle, so rows are not sorted.
    """
    firsts = resistant.groupBy(PATIENT).agg(F.min_by(WARD, F.struct(KEY, "slot")).alias(WARD))
    return firsts.groupBy(WARD).agg(F.count("*").alias("n"))


def isolation_map(resistant: DataFrame) -> DataFrame:
    """Wards by report classes, with row totals, patients per ward and a total row.

    Every input row is read once: rows are first counted per (patient, ward), which
    already happens before the shuffle, then the ward of each patient's first
    record is marked, then wards are summed. A patient number shared by many rows
    (such as the missing one) is at most one row per ward after the first step.
    """
    labels = list(CLASS_COLUMNS.values())
    cls = F.coalesce(report_class(F.col(ORGANISM)), F.lit("NA"))
    classed = resistant.select(PATIENT, WARD, KEY, cls.alias("_class"))
    per_patient = classed.groupBy(PATIENT, WARD).agg(
        *class_counts("_class", CLASSES, labels), F.min(KEY).alias("_first")
    )
    by_patient = W.partitionBy(PATIENT).orderBy("_first")
    marked = per_patient.withColumn("_counted", F.row_number().over(by_patient) == 1)
    sums = marked.groupBy(WARD).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in labels], F.count_if("_counted").alias("n_pacientes")
    )
    cells = empty_if_zero(sums, [WARD], [*labels, "n_pacientes"])
    wide = add_row_total(cells, labels, "total_unidad")
    numbers = ["n_pacientes", *labels, "total_unidad"]
    table = add_total_row(wide, WARD, numbers, TOTAL_LABEL)
    return table.select(
        "n_pacientes", F.col(WARD).alias("planta"), *labels, "total_unidad", "_is_total"
    )


def sorted_isolation_map(resistant: DataFrame) -> DataFrame:
    """The isolation map in print order: wards by name, the total row last."""
    table = isolation_map(resistant).orderBy("_is_total", F.asc_nulls_last("planta"))
    return table.drop("_is_total")


def cleaning_list(ward_rows: DataFrame) -> DataFrame:
    """Beds for double cleaning with a mark per organism, split by kind of ward.

    Beds of an unknown ward are in neither part. *C. auris* is listed under its bare
    name only, without an appended mechanism.
    """
    organism, ward = F.col(ORGANISM), F.col(WARD)
    auris, auris_mark = CLEANING_AURIS
    difficile, difficile_mark = CLEANING_DIFFICILE
    mark = F.when(organism == auris, F.lit(auris_mark)).when(
        detect(organism, difficile), F.lit(difficile_mark)
    )
    area = F.when(detect(ward, CRITICAL_WARD_PATTERN), F.lit("criticos")).otherwise(
        F.lit("hospitalizacion")
    )
    return ward_rows.filter(mark.isNotNull() & ward.isNotNull()).select(
        paste_tight(F.col(BED), mark).alias("Cama"), area.alias("area")
    )


def ward_listing(ward_rows: DataFrame, wards: Sequence[str], within: bool = True) -> DataFrame:
    """Printed listing of some wards (or of all others), by ward and bed.

    A global sort reads its input twice, once to choose the ranges; where that input
    comes out of large joins, store it first.
    """
    ward = F.col(WARD)
    chosen = ward.isin(*wards) if within else ~ward.isin(*wards)
    columns = (WARD, PATIENT, BED, "motivoAislamiento", "tipoAislamiento", "origenInfeccion")
    order = [F.asc_nulls_last(c) for c in (WARD, BED, KEY, "slot")]
    return (
        ward_rows.filter(chosen)
        .orderBy(*order)
        .select(*columns, ORGANISM, "fechaMuestra", "otroMecanismo")
    )
