"""Operators on row keys: first row per key, membership, append, upsert, merge."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlens.constants import KEY, VALID_STATUS


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """The first whole row per key in an explicit order; nulls form one key.

    Spark cuts each key to one row per task before the shuffle (window group
    limit), so a key that holds much of the data stays cheap.
    """
    by_key = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by_key)).filter("_rank = 1").drop("_rank")


def _on(left: DataFrame, right: DataFrame, key: str, null_safe: bool):
    if not null_safe:
        return key, right
    renamed = right.withColumnRenamed(key, "_right_key")
    return F.col(key).eqNullSafe(F.col("_right_key")), renamed


def _shuffle_partitions(df: DataFrame) -> int:
    """How many partitions a join or a group deals its rows to, before any are merged."""
    conf = df.sparkSession.conf
    merges = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    if first is None or any(conf.get(c) != "true" for c in merges):
        first = conf.get("spark.sql.shuffle.partitions")
    return int(first)


def spread(df: DataFrame, key: str = KEY) -> DataFrame:
    """The same rows, dealt by key to all shuffle partitions; none are merged again.

    For rows that are joined by the key and then multiplied. Adaptive execution
    merges partitions by the bytes that a stage reads, which tells nothing about
    what an explode makes of them, so a few tasks would sort it all. The shuffle
    here is the one of the join, and the join keeps its partitions.
    """
    return df.repartition(_shuffle_partitions(df), key)


def keep_known(
    df: DataFrame, known: DataFrame, key: str = KEY, null_safe: bool = False
) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    on, keys = _on(df, known.select(key), key, null_safe)
    return df.join(keys, on, "left_semi")


def drop_known(
    df: DataFrame, known: DataFrame, key: str = KEY, null_safe: bool = False
) -> DataFrame:
    """Rows whose key does not occur in ``known``."""
    on, keys = _on(df, known.select(key), key, null_safe)
    return df.join(keys, on, "left_anti")


def append(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column missing in one table is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def bind_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put the columns of two tables side by side, row for row by a common key.

    The key may be null on both sides. A row of ``left`` without a partner gets nulls.
    """
    renamed = right.withColumnRenamed(key, "_right_key")
    joined = left.join(renamed, F.col(key).eqNullSafe(F.col("_right_key")), "left")
    return joined.drop("_right_key")


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "orderId") -> DataFrame:
    """Number the rows of a small lookup table (tens of rows) in a given order.

    The numbering is one sequence, hence one task: use it for metadata only.
    """
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def snapshot_merge(
    snapshots: Sequence[DataFrame], key: str = KEY, status: str = "RECSTATUS"
) -> DataFrame:
    """One row per key from several snapshots, the newest first in the list.

    The newest row of a key wins, and only then are deleted rows removed, so a
    deletion in a newer snapshot hides live older copies.
    """
    ranked = [df.withColumn("_age", F.lit(i)) for i, df in enumerate(snapshots)]
    newest = first_per_key(append(*ranked), [key], ["_age"])
    return newest.drop("_age").filter(F.col(status) == VALID_STATUS)


def upsert_by_date(
    history: DataFrame, today: DataFrame, day: date, date_col: str = "fecha"
) -> DataFrame:
    """History without the rows of ``day``, plus the new rows, in date order.

    Dates are compared as calendar days, so a second run on one day replaces the
    first. Rows without a date are dropped, as in any comparison with a missing date.
    """
    others = history.filter(F.to_date(date_col) != F.lit(day))
    return append(others, today).orderBy(F.asc_nulls_last(date_col))
