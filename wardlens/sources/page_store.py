"""Pages of a form kept in storage by key: joined without a shuffle, purged bucket by bucket.

Two layouts. `write_bucketed` stores pages as tables that are bucketed and sorted by key, so their join
moves no rows. `write_pages` stores pages as folders with one subfolder per bucket of keys, which can be
rewritten one by one: `purge_pages` replaces only the buckets that hold purged keys, and the files of all
others stay as they are.

A purge is a list of keys that is stored first. From then on `read_pages` leaves these keys out of every
page, so all pages agree however far the rewriting has come; a purge that was stopped is finished by the
next one, or by `finish_purge`. One purge runs at a time.

`merge_snapshot` keeps a merge of database snapshots in the same layout, with a digest for each row, so that
a newer snapshot rewrites only the buckets of keys that it changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.constants import KEY, VALID_STATUS
from wardlens.sources.sinks import durable, shared_folder

#: Subfolders of a stored page. A bucket is what a purge of one key rewrites.
BUCKETS = 64
_BUCKET, _PENDING = "_cubo", "_pendiente"


def write_bucketed(
    pages: Mapping[str, DataFrame], folder: str, prefix: str, buckets: int = BUCKETS, key: str = KEY
) -> dict[str, DataFrame]:
    """Each page as an external table ``prefix + name`` under ``folder``, bucketed and sorted by key.

    Returns the tables, read back. Tables with the same number of buckets join on the key without a
    shuffle, at any size; rows without a key share one bucket.
    """
    found = {}
    for name, page in pages.items():
        table = f"{prefix}{name}"
        dealt = page.repartition(buckets, key)  # one file per bucket
        writer = dealt.write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
        writer.option("path", f"{folder}/{table}").format("parquet").saveAsTable(table)
        found[name] = page.sparkSession.table(table)
    return found


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_pages(pages: Mapping[str, DataFrame], folder: str, buckets: int = BUCKETS, key: str = KEY) -> None:
    """Each page to its own folder, in subfolders by key. A row without key has a bucket like any other."""
    for name, page in pages.items():
        placed = page.withColumn(_BUCKET, _bucket(key, buckets))
        placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/{name}")


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _stands(spark: SparkSession, path: str) -> bool:
    path, system = _path(spark, path)
    return system.exists(path)


def _remove(spark: SparkSession, path: str) -> None:
    path, system = _path(spark, path)
    system.delete(path, True)


def _pending(spark: SparkSession, folder: str) -> DataFrame | None:
    """The keys of a purge that is not finished; a list that was not written whole does not count."""
    path = f"{folder}/{_PENDING}"
    return spark.read.parquet(path) if _stands(spark, f"{path}/_SUCCESS") else None


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def read_pages(spark: SparkSession, folder: str, names: Sequence[str], key: str = KEY) -> dict[str, DataFrame]:
    """The stored pages, without the keys of a purge that is under way."""
    gone = _pending(spark, folder)
    pages = {name: _stored(spark, folder, name).drop(_BUCKET) for name in names}
    return pages if gone is None else {n: page.join(gone, key, "left_anti") for n, page in pages.items()}


def purge_pages(
    spark: SparkSession,
    folder: str,
    names: Sequence[str],
    doomed: DataFrame,
    buckets: int = BUCKETS,
    key: str = KEY,
) -> None:
    """Take the keys of ``doomed`` out of all stored pages, rewriting only buckets that hold one of them.

    ``buckets`` is the number the pages were written with. Keys that no page has, and missing keys, change
    nothing; the same purge again changes nothing.
    """
    finish_purge(spark, folder, names, buckets, key)
    keys = doomed.select(key).filter(F.col(key).isNotNull()).distinct()
    keys.write.mode("overwrite").parquet(f"{folder}/{_PENDING}")
    finish_purge(spark, folder, names, buckets, key)


def finish_purge(
    spark: SparkSession, folder: str, names: Sequence[str], buckets: int = BUCKETS, key: str = KEY
) -> None:
    """Rewrite what an earlier purge has left, if there is one."""
    gone = _pending(spark, folder)
    if gone is None:
        return
    for name in names:
        _purge_page(spark, folder, name, gone, buckets, key)
    _remove(spark, f"{folder}/{_PENDING}")


def _purge_page(spark: SparkSession, folder: str, name: str, gone: DataFrame, buckets: int, key: str) -> None:
    page = _stored(spark, folder, name)
    hit = page.select(key, _BUCKET).join(gone, key, "left_semi").select(_BUCKET).distinct()
    touched = sorted(r[0] for r in hit.collect())  # at most `buckets` rows
    if not touched:
        return
    held = page.filter(F.col(_BUCKET).isin(touched))
    rest = held.join(gone, key, "left_anti")
    left = {r[0] for r in rest.select(_BUCKET).distinct().collect()}
    (
        rest.repartition(_BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_BUCKET)
        .parquet(f"{folder}/{name}")
    )
    for bucket in set(touched) - left:  # nothing is written for a bucket without rows
        _remove(spark, f"{folder}/{name}/{_BUCKET}={bucket}")
    spark.catalog.refreshByPath(f"{folder}/{name}")


_DIGEST = "_huella"


def row_digest(df: DataFrame) -> Column:
    """A digest of all values of a row by column name; missing values and missing columns count alike."""
    named = F.struct(*[F.col(c) for c in sorted(df.columns) if c not in (_BUCKET, _DIGEST)])
    return F.sha2(F.to_json(named).cast("binary"), 256)


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The live rows of a stored merge; columns that some snapshots lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(folder).drop(_BUCKET, _DIGEST)


def merge_snapshot(
    spark: SparkSession,
    folder: str,
    snapshot: DataFrame,
    buckets: int = BUCKETS,
    key: str = KEY,
    status: str = "RECSTATUS",
) -> int:
    """Bring a stored merge up to a newer snapshot; the number of keys that changed.

    The stored merge has the live rows of all snapshots so far, each with the digest of its values. A key of
    the new snapshot changes something only if its row is live and its digest is not the stored one, or if it
    is deleted and stored; only buckets with such keys are rewritten, so the cost is that of the change.
    Applied one after the other, the oldest first, snapshots give what ``operators.keys.snapshot_merge`` gives
    of all at once, deletions included. The same snapshot again changes nothing, so a run that was stopped is
    repeated. A key occurs once in a snapshot; rows without key are not merged.
    """
    live = F.coalesce(F.col(status) == VALID_STATUS, F.lit(False))
    rows = snapshot.filter(F.col(key).isNotNull())
    told = rows.withColumns({_DIGEST: row_digest(rows), _BUCKET: _bucket(key, buckets)})
    if not _stands(spark, folder):
        first = told.filter(live)
        first.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        return spark.read.parquet(folder).count()
    stored = spark.read.option("mergeSchema", True).parquet(folder)
    have = stored.select(F.col(key).alias("_k"), F.col(_DIGEST).alias("_d"))
    state = told.select(key, _BUCKET, _DIGEST, live.alias("_vivo"))
    met = state.join(have, F.col(key) == F.col("_k"), "left")
    differs = (F.col("_vivo") & ~F.col(_DIGEST).eqNullSafe(F.col("_d"))) | (~F.col("_vivo") & F.col("_k").isNotNull())
    changed = durable(met.filter(differs).select(key, _BUCKET, "_vivo"), shared_folder(spark))
    touched = [r[0] for r in changed.select(_BUCKET).distinct().collect()]  # at most `buckets` rows
    if not touched:
        return 0
    held = stored.filter(F.col(_BUCKET).isin(touched)).join(changed.select(key), key, "left_anti")
    fresh = told.join(changed.filter("_vivo").select(key), key, "left_semi")
    rest = durable(held.unionByName(fresh, allowMissingColumns=True), shared_folder(spark))
    (
        rest.repartition(_BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_BUCKET)
        .parquet(folder)
    )
    left = {r[0] for r in rest.select(_BUCKET).distinct().collect()}
    for bucket in set(touched) - left:
        _remove(spark, f"{folder}/{_BUCKET}={bucket}")
    spark.catalog.refreshByPath(folder)
    return changed.count()
