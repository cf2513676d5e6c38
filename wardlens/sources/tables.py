"""Table discovery, reading, and the one-to-one join of the pages of a form."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlens.constants import KEY

log = logging.getLogger(__name__)

JDBC_SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def list_tables(
    spark: SparkSession, containing: str = "", database: str | None = None
) -> list[str]:
    """Names of the catalog tables that contain a text.

    Upper and lower case differ where the session is case-sensitive; elsewhere the
    catalog itself stores names in small letters, so they do not.
    """
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    wanted = containing if exact else containing.lower()
    names = [t.name for t in spark.catalog.listTables(database)]
    return sorted(n for n in names if wanted in (n if exact else n.lower()))


def fetch_table(
    spark: SparkSession, name: str, fmt: str | None = None, **options: str
) -> DataFrame:
    """A whole table: from the catalog, or from any Spark source when ``fmt`` is given.

    With ``fmt="jdbc"`` the four options of ``JDBC_SPLIT`` are required, so that the
    read is split over the executors; filters and column choices reach the source
    either way.
    """
    if fmt is None:
        return spark.table(name)
    if fmt == "jdbc":
        if missing := [o for o in JDBC_SPLIT if o not in options]:
            raise ValueError(f"one task would read all of {name}: set {', '.join(missing)}")
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    return spark.read.format(fmt).options(**options).load(name)


def fetch_optional(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A catalog table, or an empty frame of the declared schema if it is missing."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    log.warning("table %s does not exist; using an empty one", name)
    return spark.createDataFrame([], schema)


def first_with_column(tables: Mapping[str, DataFrame], column: str) -> DataFrame | None:
    """The first table that has a column; looks at schemas only."""
    return next((df for df in tables.values() if column in df.columns), None)


def prune_pages(
    pages: Mapping[str, DataFrame], columns: Iterable[str], key: str = KEY
) -> dict[str, DataFrame]:
    """The first page and those that supply a wanted column, cut to those columns.

    Pages are one-to-one on the key, so leaving one out of the left joins never
    changes the rows; it saves its scan and its shuffle.
    """
    wanted = set(columns)
    cut: dict[str, DataFrame] = {}
    for i, (name, page) in enumerate(pages.items()):
        keep = [c for c in page.columns if c in wanted and c != key]
        if i == 0 or keep:
            cut[name] = page.select(key, *keep)
    return cut


def _join_page(left: DataFrame, right: DataFrame, key: str, null_safe: bool) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns and c != key]
    left = left.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    if not null_safe:
        return left.join(right, key, "left")
    right = right.withColumnRenamed(key, "_right_key")
    return left.join(right, F.col(key).eqNullSafe(F.col("_right_key")), "left").drop("_right_key")


def join_pages(
    pages: Mapping[str, DataFrame],
    columns: Iterable[str] | None = None,
    key: str = KEY,
    null_safe: bool = False,
) -> DataFrame:
    """All pages of a form as one wide row per record of the first page.

    Every join has the same key, so Spark shuffles each page once and keeps the
    partitioning from join to join. Columns of the same name get ``_x`` / ``_y``.
    """
    chosen = dict(pages) if columns is None else prune_pages(pages, columns, key)
    return reduce(lambda a, b: _join_page(a, b, key, null_safe), chosen.values())


def load_snapshot(
    spark: SparkSession,
    containing: str,
    database: str | None = None,
    columns: Iterable[str] | None = None,
    key: str = KEY,
) -> DataFrame:
    """One database as a single wide table: find its pages, read and join them."""
    prefix = f"{database}." if database else ""
    names = list_tables(spark, containing, database)
    pages = {n: fetch_table(spark, prefix + n) for n in names}
    return join_pages(pages, columns, key)
