"""What the corpus operators share: reading, staging, words and word numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.operators.ordered import free_name

#: Rows that cross to Python at once; long texts make a batch large.
ARROW_ROWS = 1000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows; whole texts cross in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def as_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text in UTF-8 (null: empty), with the columns named in `more`; others go."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def per_batch(
    frame: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Apply `function` to each Arrow batch; it returns the columns of `schema` by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            arrays = [pa.array(out[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return frame.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (local runs), one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wardlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: computed once, whatever executors are lost."""
    path = f"{shared_folder(frame.sparkSession)}/stage-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def rows_named(docs: DataFrame, stay: DataFrame, digest: Column) -> DataFrame:
    """The rows of `docs` whose doc_id and digest are in `stay` (doc_id, digest, once).

    Where `once` is true, one row stays of those that share doc_id and digest.
    """
    # names that no column of `docs` has, in any case
    key, told, once, mine, row = (free_name(docs, c) for c in ("__id", "__digest", "__once", "__own", "__row"))
    named = stay.toDF(key, told, once)
    own = docs.withColumn(mine, digest)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(told))
    order = Window.partitionBy(key, told).orderBy(mine)
    found = own.join(named, same).withColumn(row, F.row_number().over(order))
    return found.filter((F.col(row) == 1) | ~F.col(once)).select(*docs.columns)


def lowered(text: bytes) -> bytes:
    """A-Z only."""
    return text.translate(_LOWER)


class WordNumbers(dict):
    """64-bit numbers of words, remembered for as many as fit `limit`."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = number
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input moves about half of the output's."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def grams(numbers: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of `size` words; empty when there are fewer."""
    n = len(numbers) - size + 1
    if n <= 0:
        return numbers[:0]
    each = mixed(numbers)
    with np.errstate(over="ignore"):
        total = each[:n].copy()
        for i in range(1, size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + each[i : n + i]
    return mixed(total)
