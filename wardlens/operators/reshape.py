"""Wide to long and back, and cross tables with totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a cross table whose classes are found in the data.
MOST_CLASSES = 200


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def measures_long(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per measure; nulls are kept."""
    return df.unpivot(list(ids), list(measures), name, value)


def metrics_long(row: DataFrame, names: Sequence[str], name: str, value: str) -> DataFrame:
    """The columns of a metrics row as (name, value) rows, all values as double."""
    typed = row.select(*[F.col(c).cast("double").alias(c) for c in names])
    return typed.unpivot([], list(names), name, value)


def long_to_rows(
    long: DataFrame, keys: Sequence[str], names: Sequence[str], name: str, value: str
) -> DataFrame:
    """Back to one row per key with one column per name, from a fixed list of names.

    A maximum of texts needs the rows sorted, so a task holds or spills all its long
    rows; where they come from an explode, ``keys.spread`` the records before it.
    """
    cells = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return long.groupBy(*keys).agg(*cells)


def class_counts(cls: str, classes: Sequence[str], labels: Sequence[str]) -> list[Column]:
    """One count per class of a class column, as aggregate expressions."""
    return [
        F.expr(f"count_if(`{cls}` = '{c}') AS `{n}`") for c, n in zip(classes, labels, strict=True)
    ]


def empty_if_zero(df: DataFrame, keep: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """The kept columns and the counts, a zero count as null."""
    return df.selectExpr(*_quoted(keep), *[f"nullif(`{n}`, 0) AS `{n}`" for n in counts])


def cross_table(
    df: DataFrame, row_key: str, cls: str, classes: Sequence[str], labels: Sequence[str]
) -> DataFrame:
    """Rows by classes; a combination that never occurs is null.

    The classes are given, so the column list needs no look at the data, and all
    counts come out of one aggregation.
    """
    counts = df.groupBy(row_key).agg(*class_counts(cls, classes, labels))
    return empty_if_zero(counts, [row_key], labels)


def add_row_total(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Sum over columns, nulls as zero."""
    total = " + ".join(f"coalesce(`{c}`, 0)" for c in cols)
    return df.selectExpr("*", f"{total} AS `{name}`")


def add_total_row(df: DataFrame, row_key: str, cols: Sequence[str], label: str) -> DataFrame:
    """Append a row with the column sums, nulls as zero.

    ``df`` has one row per key, so a rollup repeats every row unchanged and adds
    the total in the same pass. The column ``_is_total`` is true on the added row.
    """
    sums = [F.expr(f"sum(`{c}`) AS `{c}`") for c in cols]
    rolled = df.rollup(row_key).agg(F.expr(f"grouping(`{row_key}`) = 1 AS _is_total"), *sums)
    return rolled.selectExpr(
        f"IF(_is_total, '{label}', `{row_key}`) AS `{row_key}`",
        *[f"IF(_is_total, coalesce(`{c}`, 0), `{c}`) AS `{c}`" for c in cols],
        "_is_total",
    )


def drop_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Leave out columns without any value; for small printed tables (reads the data)."""
    row = df.agg(*[F.expr(f"count_if(`{c}` > 0) AS `{c}`") for c in cols]).first()
    return df.drop(*[c for c in cols if not row[c]])


def found_classes(df: DataFrame, col: str, most: int = MOST_CLASSES) -> list[str]:
    """The different values of a column in binary order, without null; an error where there are over ``most``.

    Each task keeps ``most`` + 1 values at most, so a column that is no class is noticed cheaply.
    """
    rows = df.select(F.col(col).cast("string").alias("c")).filter("c IS NOT NULL").distinct()
    values = [r.c for r in rows.limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} different values")
    return sorted(values, key=str.encode)


def cross_table_found(
    df: DataFrame, row: str, col: str, most: int = MOST_CLASSES, label: Callable[[str], str] = str
) -> DataFrame:
    """Rows by the classes that the data has, one column each in binary order; no row counts as null.

    ``label`` makes column names of classes. Rows whose class is missing count in no column, but their row
    value still has a row.
    """
    classes = found_classes(df, col, most)
    names = [label(c) for c in classes]
    if len({n.lower() for n in (*names, row)}) <= len(names):
        raise ValueError(f"classes of {col} that would share a column name")
    of = F.col(col).cast("string")
    cells = [F.nullif(F.count_if(of == F.lit(c)), F.lit(0)).alias(n) for c, n in zip(classes, names)]
    return df.groupBy(row).agg(*cells) if cells else df.select(row).distinct()
