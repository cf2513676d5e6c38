"""Writing results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(
    tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet"
) -> None:
    """Each result table to its own folder, as parquet or as csv with a header."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")


def overwrite_table(df: DataFrame, table: str, dates: tuple[str, ...] = ("fecha",)) -> None:
    """Replace a catalog table, with the named columns stored as dates.

    ``df`` must not read the table itself; use :func:`safe_replace` for that.
    """
    typed = df.withColumns({c: F.to_date(c) for c in dates if c in df.columns})
    typed.write.mode("overwrite").saveAsTable(table)


class ChangedMeanwhile(RuntimeError):
    """The table is no longer the one that was read."""


_VERSION = "wardlens.version"
ANY_VERSION = "any"


def table_version(spark: SparkSession, table: str) -> str | None:
    """What tells the present state of a table from later ones; null for a missing table or another writer's."""
    if not spark.catalog.tableExists(table):
        return None
    told = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return told.get(_VERSION)


def safe_replace(
    df: DataFrame,
    table: str,
    dates: tuple[str, ...] = ("fecha",),
    suffix: str = "_copia",
    version: str | None = ANY_VERSION,
) -> None:
    """Replace a catalog table by rows that may have been read from it.

    The new rows are written whole to a second table first, under a name of this run. Only then is the
    old table set aside, the new one given its name, and the old one dropped. At any moment a complete
    copy of either state exists under one of the names, and the data is written once.

    With ``version=table_version(...)``, taken before the rows were read, the table is replaced only
    if it is still that one; else :class:`ChangedMeanwhile` is raised and nothing changes. Of two runs
    that read the same state one succeeds. The state is compared right before the swap.
    """
    spark = df.sparkSession
    backup = f"{table}{suffix}"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(backup):
        # an earlier run stopped between the two renames
        spark.sql(f"ALTER TABLE {backup} RENAME TO {table}")
    run = uuid.uuid4().hex
    fresh = f"{table}_nueva_{run}"
    try:
        overwrite_table(df, fresh, dates)
        spark.sql(f"ALTER TABLE {fresh} SET TBLPROPERTIES ('{_VERSION}' = '{run}')")
        if version is not ANY_VERSION and table_version(spark, table) != version:
            raise ChangedMeanwhile(f"{table} was replaced by another run since it was read")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {backup}")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} RENAME TO {backup}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {backup}")


def overwrite_days(df: DataFrame, folder: str, date_col: str = "fecha") -> None:
    """Write a day-partitioned history so that only the days in ``df`` are replaced.

    Running it again for the same day gives the same table, and the cost is that
    of one day, not of the history. Rows are gathered by day into files of sensible
    size; a day with very many rows is split over several tasks.
    """
    (
        df.withColumn(date_col, F.to_date(date_col))
        .hint("rebalance", date_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col)
        .parquet(folder)
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wardlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows, written once as parquet to a folder that all executors share.

    For a frame that feeds several reports: later reads come from storage, with the columns and
    filters they need, and a lost executor does not bring back the joins behind it. Without
    ``folder`` the one of ``spark.checkpoint.dir`` is used.
    """
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a shared folder, or set spark.checkpoint.dir")
    path = f"{folder}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
