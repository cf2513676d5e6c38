"""Bed movements of a record."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.constants import KEY
from wardlens.operators.columns import matching

ADMISSION, MOVE, DISCHARGE = "ingreso", "movimiento", "alta"


def bed_movements(wide: DataFrame, key: str = KEY) -> DataFrame:
    """Admission, moves and discharge of each record with the bed in force.

    Dates and beds are paired by the number in their column names. Undated entries
    and repeats of the same kind, date and bed are dropped; then a missing bed is
    filled from the entry before it in the record (never from another record). It
    is all computed in the record's own row; only the result is exploded.
    """
    dates = {re.search(r"\d+", c).group(): c for c in matching(wide, r"fechaIngreso\d")}
    beds = {re.search(r"\d+", c).group(): c for c in matching(wide, r"cama\d")}
    no_bed = F.lit(None).cast("string")

    entries = []
    for number, column in dates.items():
        kind = ADMISSION if column == "fechaIngreso1" else MOVE
        paired = number in beds
        bed = F.col(beds[number]).cast("string") if paired else no_bed
        date = F.col(column) if paired else F.lit(None).cast(wide.schema[column].dataType)
        entries.append((kind, date, bed))
    entries.append((DISCHARGE, F.col("fechaAlta"), no_bed))

    # which entries count: dated, and no repeat of an earlier one
    marks = {}
    for i, (kind, date, bed) in enumerate(entries):
        repeats = [
            date.eqNullSafe(d) & bed.eqNullSafe(b) for k, d, b in entries[:i] if k == kind
        ]
        fresh = [~reduce(or_, repeats)] if repeats else []
        marks[f"_kept{i}"] = reduce(and_, [date.isNotNull(), *fresh])
    marked = wide.withColumns(marks)

    moves = []
    for i, (kind, date, bed) in enumerate(entries):
        earlier = [F.when(F.col(f"_kept{j}"), entries[j][2]) for j in range(i - 1, -1, -1)]
        move = F.struct(
            F.lit(i + 1).alias("orden"),
            F.lit(kind).alias("tipo"),
            F.coalesce(bed, *earlier).alias("cama"),
            date.alias("fecha"),
        )
        moves.append(F.when(F.col(f"_kept{i}"), move))
    return (
        marked.select(key, "aSIP", "aNHC", F.explode(F.array(*moves)).alias("_move"))
        .filter(F.col("_move").isNotNull())
        .select(key, "aSIP", "aNHC", "_move.*")
    )
