"""Exact duplicates by recipes of content-defined chunks.

Texts are equal when identical after lower-casing A-Z. Each text is cut where a rolling hash of
the last 32 bytes says so, so equal stretches give equal chunks wherever they stand. A chunk's
identifier is its digest and its rank among the different chunks of that digest: the dictionary of
distinct chunks (combined in each task before it is moved, so a chunk that a third of all
documents share travels once per task) shows which digests stand for more than one content. Such
chunks, none with the full width, get their rank by joining on the content itself. Documents are
then compared by their ordered lists of identifiers, some 1.5 % of the length of the text; no
whole document is moved.

Of equal texts the row with the largest doc_id stays. Null texts count as empty, and all empty
texts are equal. Null doc_ids sort below all others; when rows share the largest doc_id, all of
them have `kept` true (`deduplicated` then keeps one). A very long text is cut by one task in linear time and
moves as its chunks. An empty table gives an empty result, and
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import as_texts, lowered, per_batch, rows_named, staged

#: Bytes of the rolling window, and a cut at one in 2^CUT_BITS places: chunks of about 1 KB.
WINDOW, CUT_BITS, LEAST, MOST = 32, 10, 256, 8192
DIGEST_BYTES = 16
SALTS = 32

_GEAR = np.random.default_rng(20260101).integers(0, 2**32, 256, dtype=np.uint32)


def cut_places(text: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    rolled = _GEAR[np.frombuffer(text, np.uint8)]
    width = 1
    while width < WINDOW:  # rolled[i] covers the `width` bytes up to i
        later = rolled.copy()
        later[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = later, 2 * width
    marks = np.flatnonzero(rolled[WINDOW:] >> np.uint32(32 - CUT_BITS) == 0) + WINDOW + 1
    ends, start = [], 0
    for place in marks.tolist():
        if place - start < LEAST:
            continue
        while place - start > MOST:
            start += MOST
            ends.append(start)
        if place - start >= LEAST:
            ends.append(place)
            start = place
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(text: bytes) -> list[bytes]:
    ends = cut_places(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def chunk_rows(docs: DataFrame, size: int) -> DataFrame:
    """The distinct chunks of each batch with their digests."""

    def cut(batch):
        distinct = {c for t in batch.column("text").to_pylist() for c in chunks_of(lowered(t))}
        return {"digest": [digest(c, size) for c in distinct], "chunk": list(distinct)}

    return per_batch(as_texts(docs), cut, "digest binary, chunk binary")


def ambiguous_chunks(docs: DataFrame, size: int = DIGEST_BYTES) -> DataFrame:
    """Chunks whose digest stands for several contents, with their rank among these."""
    contents = chunk_rows(docs, size).distinct().groupBy("digest").count()
    unclear = staged(contents.filter("count > 1").select("digest"))
    if unclear.isEmpty():
        return unclear.select("digest", F.lit(b"").alias("chunk"), F.lit(0).alias("rank"))
    chunks = chunk_rows(docs, size).join(unclear, "digest", "left_semi").distinct()
    below = chunks.withColumnRenamed("chunk", "other")
    ranks = chunks.join(below, "digest").filter(F.col("other") < F.col("chunk"))
    ranks = ranks.groupBy("digest", "chunk").agg(F.count("*").cast("int").alias("rank"))
    return chunks.join(ranks, ["digest", "chunk"], "left").fillna(0, ["rank"])


def recipes(docs: DataFrame, size: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, text_sha256 and the ordered identifiers of each text's chunks, once verified."""

    def write(batch):
        out = {"text_sha256": [], "recipe": []}
        for text in batch.column("text").to_pylist():
            text = lowered(text)
            out["text_sha256"].append(hashlib.sha256(text).hexdigest())
            out["recipe"].append([digest(c, size) for c in chunks_of(text)])
        return out | {"doc_id": batch.column("doc_id")}

    unclear = staged(ambiguous_chunks(docs, size))
    if unclear.isEmpty():
        schema = "doc_id long, text_sha256 string, recipe array<binary>"
        return per_batch(as_texts(docs), write, schema)
    return _ranked_recipes(docs, unclear, size)


def _ranked_recipes(docs: DataFrame, unclear: DataFrame, size: int) -> DataFrame:
    """Recipes where digests alone do not tell chunks apart."""

    def place(batch):
        out = {k: [] for k in ("doc_id", "row", "text_sha256", "place", "digest", "chunk")}
        ids = batch.column("doc_id").to_pylist()
        rows = batch.column("row").to_pylist()
        for doc_id, row, text in zip(ids, rows, batch.column("text").to_pylist()):
            text = lowered(text)
            sha = hashlib.sha256(text).hexdigest()
            for k, chunk in enumerate(chunks_of(text) or [b""]):
                for name, value in zip(out, (doc_id, row, sha, k, digest(chunk, size), chunk)):
                    out[name].append(value)
        return out

    schema = (
        "doc_id long, row string, text_sha256 string, place int, digest binary, chunk binary"
    )
    numbered = staged(as_texts(docs).withColumn("row", F.expr("uuid()")))
    placed = per_batch(numbered, place, schema)
    known = placed.join(unclear, ["digest", "chunk"], "left").fillna(0, ["rank"])
    identifier = F.concat("digest", F.encode(F.format_string("%08x", "rank"), "UTF-8"))
    listed = known.groupBy("row", "doc_id", "text_sha256").agg(
        F.array_sort(F.collect_list(F.struct("place", identifier.alias("identifier")))).alias("all")
    )
    return listed.select("doc_id", "text_sha256", F.col("all.identifier").alias("recipe"))


def exact_groups(docs: DataFrame, size: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per row of `docs`."""
    listed = staged(recipes(docs, size))
    groups = listed.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    # a group may hold a third of all rows: its rows are dealt over SALTS keys, its answer to each
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    several = groups.filter("group_size > 1").withColumn("salt", salts)
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(several, ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, size: int = DIGEST_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of equal texts."""
    groups = exact_groups(docs, size).filter("kept")
    stay = groups.select("doc_id", "text_sha256", F.lit(True).alias("once")).distinct()
    normal = F.translate(
        F.coalesce(F.col("text").cast("string"), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )
    return rows_named(docs, stay, F.sha2(normal.cast("binary"), 256))
