"""Passages repeated from other documents, found by suffix automata of reference shards.

Words are runs of `[^\\x20\\x09-\\x0D]`. A window is `length` consecutive words of a document; a word is
removed when a window over it also starts in a document with a smaller doc_id.

Streaming every document past automata of the whole corpus grows with its square, so references
and documents are cut into shards that need only be compared within themselves:

1. A window's minimizer is the smallest hash of its `GRAM`-word runs. Consecutive windows with one
   minimizer form a stretch; equal windows have equal minimizers, so all that a stretch can repeat
   is in stretches of the same minimizer. Minimizers that only one document has go at once.
2. Stretches with one content (a digest) are one reference. In all its documents but the first, all
   of its words go; no text is moved for these, whatever the size of a group of copies.
3. Where a minimizer has several contents, they are its shard. In order of doc_id each content is
   streamed past the suffix automaton of those before it: where the longest match that ends at a
   word reaches `length`, the window that ends there is a repeat. A shard's automaton lives in the
   task that holds the shard, in place of a broadcast that would grow with the corpus.
4. A minimizer with more than `shard` contents (the rim of a passage that very many documents share)
   is left to exact counting: its windows' 128-bit digests get their first document by an
   aggregation that combines in each task before it moves, so no shard outgrows a task.

A null text has no words. Rows with a null doc_id come after all others and are no reference for each
other; rows that share a doc_id are no reference for each other either, and each gets its own
result. Texts shorter than a window keep all words. A very long text is cut like any other, so no task but
the one that cuts it holds it whole. An empty table gives an empty result. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import WordNumbers, as_texts, grams, per_batch, staged
from wardlens.llm.suffix_automaton import SuffixAutomaton

LENGTH, GRAM = 50, 10
#: Windows in a stretch at most, and contents of a minimizer that one automaton holds.
STRETCH, SHARD = 200, 400
SALTS = 32
_LAST = 2**63 - 1


def minimizers(numbers: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash of the word runs of each window."""
    small = grams(numbers, min(GRAM, length))
    width, want = 1, length - min(GRAM, length) + 1
    while 2 * width <= want:
        small = np.minimum(small[:-width], small[width:])
        width *= 2
    if want > width:
        small = np.minimum(small[: len(small) - (want - width)], small[want - width :])
    return small


def stretches(words: list[bytes], numbers: np.ndarray, length: int):
    """(minimizer, first word, end word) of the stretches of a text."""
    if len(words) < length:
        return
    small = minimizers(numbers, length)
    cuts = np.flatnonzero(small[1:] != small[:-1]) + 1
    edges = [0, *cuts.tolist(), len(small)]
    for low, high in zip(edges, edges[1:]):
        for start in range(low, high, STRETCH):
            yield int(small[low]), start, min(start + STRETCH, high) + length - 1


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _content(words: list[bytes], start: int, end: int) -> int:
    digest = hashlib.blake2b(b" ".join(words[start:end]), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def rows_of(docs: DataFrame) -> DataFrame:
    """order (doc_id, null last), text_hash and text; the first two name a row."""
    return as_texts(docs).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_LAST)).alias("order"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )


def stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    """minimizer, content, order, text_hash and place (first word and end word in one number)."""
    memory = WordNumbers()

    def cut(batch):
        out = {k: [] for k in ("minimizer", "content", "order", "text_hash", "place")}
        orders, hashes = batch.column("order").to_pylist(), batch.column("text_hash").to_pylist()
        for order, text_hash, text in zip(orders, hashes, batch.column("text").to_pylist()):
            words = text.split()
            if len(words) < length:
                continue
            for small, start, end in stretches(words, memory.of(words), length):
                out["minimizer"].append(_signed(small))
                out["content"].append(_content(words, start, end))
                out["order"].append(order)
                out["text_hash"].append(text_hash)
                out["place"].append(start << 32 | end)
        return out

    schema = "minimizer long, content long, order long, text_hash long, place long"
    return per_batch(rows_of(docs).drop("doc_id"), cut, schema)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted stretches (order, text_hash, list of minimizer, n and place) with their words."""

    def fetch(batch):
        out = {k: [] for k in ("minimizer", "contents", "order", "text_hash", "start", "words")}
        columns = [batch.column(c).to_pylist() for c in ("order", "text_hash", "text", "wanted")]
        for order, text_hash, text, spans in zip(*columns):
            words = text.split()
            for span in spans:
                start, end = span["place"] >> 32, span["place"] & 0xFFFFFFFF
                out["minimizer"].append(span["minimizer"])
                out["contents"].append(span["contents"])
                out["order"].append(order)
                out["text_hash"].append(text_hash)
                out["start"].append(start)
                out["words"].append(b" ".join(words[start:end]))
        return out

    schema = (
        "minimizer long, contents long, order long, text_hash long, start int, words binary"
    )
    met = rows_of(docs).drop("doc_id").join(wanted, ["order", "text_hash"])
    return per_batch(met, fetch, schema)


def repeated(entries: list[tuple[int, bytes]], length: int) -> list[list[int]]:
    """For each (order, words) of a shard, ascending by order, the starts of repeated windows.

    A window counts as repeated when an entry of smaller order has it.
    """
    automaton, out, waiting, done = SuffixAutomaton(), [], [], {}
    for k, (order, joined) in enumerate(entries):
        if k and order != entries[k - 1][0]:
            for words in waiting:
                automaton.add(words)
            waiting, done = [], {}
        if joined not in done:
            words = joined.split(b" ")
            matches = automaton.matches(words)
            done[joined] = [i - length + 1 for i, m in enumerate(matches) if m >= length]
            if len(done[joined]) < len(words) - length + 1:
                waiting.append(words)
        out.append(done[joined])
    return out


def as_runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    """(first word, end word) of the merged windows with ascending starts."""
    runs: list[tuple[int, int]] = []
    for start in starts:
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], start + length)
        else:
            runs.append((start, start + length))
    return runs


def shard_spans(texts: DataFrame, length: int) -> DataFrame:
    """order, text_hash and place of the repeated words, shard by shard within each task."""
    schema = pa.schema([(n, pa.int64()) for n in ("order", "text_hash", "place")])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[dict] = []

        def finish():
            found = []
            entries = [(r["order"], r["words"]) for r in shard]
            for row, starts in zip(shard, repeated(entries, length)):
                for low, high in as_runs(starts, length):
                    place = (row["start"] + low) << 32 | (row["start"] + high)
                    found.append({"order": row["order"], "text_hash": row["text_hash"], "place": place})
            return pa.RecordBatch.from_pylist(found, schema=schema)

        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if shard and row["minimizer"] != shard[0]["minimizer"]:
                    ready.append(finish())
                    shard = []
                shard.append(row)
            yield from pa.Table.from_batches(ready, schema=schema).combine_chunks().to_batches()
        if shard:
            yield finish()

    dealt = texts.repartition("minimizer").sortWithinPartitions("minimizer", "order", "start")
    return dealt.mapInArrow(match, "order long, text_hash long, place long")


def counted_spans(texts: DataFrame, length: int) -> DataFrame:
    """The same by the first document of each window's digest; for minimizers with many contents."""

    def digests(batch):
        out = {k: [] for k in ("window", "order", "text_hash", "place")}
        columns = [batch.column(c).to_pylist() for c in ("order", "text_hash", "start", "words")]
        for order, text_hash, start, joined in zip(*columns):
            words = joined.split(b" ")
            for i in range(len(words) - length + 1):
                window = b" ".join(words[i : i + length])
                out["window"].append(hashlib.blake2b(window, digest_size=16).digest())
                out["order"].append(order)
                out["text_hash"].append(text_hash)
                out["place"].append((start + i) << 32 | (start + i + length))
        return out

    schema = "window binary, order long, text_hash long, place long"
    windows = staged(per_batch(texts, digests, schema))
    first = windows.groupBy("window").agg(F.min("order").alias("first"), F.max("order").alias("last"))
    # a window may stand in a third of all documents: these are dealt over SALTS keys
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = first.filter("first < last").select("window", "first", salts.alias("salt"))
    salt = F.pmod(F.xxhash64("order", "place"), F.lit(SALTS)).cast("int")
    met = windows.withColumn("salt", salt).join(first, ["window", "salt"])
    return met.filter("order > first").select("order", "text_hash", "place")


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """order, text_hash and place of words to remove; spans may overlap."""
    rows = staged(stretch_rows(docs, length))
    met = rows.groupBy("minimizer").agg(F.min("order").alias("low"), F.max("order").alias("high"))
    met = met.filter("low < high").select("minimizer")
    rows = staged(rows.join(met, "minimizer"))
    contents = rows.groupBy("minimizer", "content").agg(
        F.min("order").alias("first"), F.max("order").alias("last")
    )
    contents = staged(contents)
    sizes = contents.groupBy("minimizer").agg(F.count("*").alias("contents"))
    told = contents.join(sizes, "minimizer").filter("first < last OR contents > 1")
    found = staged(rows.join(told, ["minimizer", "content"]))
    copies = found.filter("order > first").select("order", "text_hash", "place")
    wanted = found.filter("order = first AND contents > 1").groupBy("order", "text_hash").agg(
        F.collect_list(F.struct("minimizer", "contents", "place")).alias("wanted")
    )
    texts = staged(_texts(docs, wanted))
    few = shard_spans(texts.filter(F.col("contents") <= shard), length)
    many = counted_spans(texts.filter(F.col("contents") > shard), length)
    return copies.unionByName(few).unionByName(many)


def covered(n: int, places: list[int]) -> np.ndarray:
    """Which of n words the places cover."""
    edges = np.zeros(n + 1, np.int64)
    at = np.array(places, np.int64)
    np.add.at(edges, at >> 32, 1)
    np.add.at(edges, at & 0xFFFFFFFF, -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(
    docs: DataFrame, length: int = LENGTH, shard: int = SHARD, texts: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `texts`, the kept words joined by a space."""
    spans = staged(repeated_spans(docs, length, shard))
    per_row = spans.groupBy("order", "text_hash").agg(F.collect_set("place").alias("places"))

    def clean(batch):
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
        for text, places in zip(
            batch.column("text").to_pylist(), batch.column("places").to_pylist()
        ):
            words = text.split()
            n = len(words)
            if places:
                gone = covered(n, places).tolist()
                words = [w for w, g in zip(words, gone) if not g]
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "replace") if texts else None)
        return out | {"doc_id": batch.column("doc_id")}

    found = rows_of(docs).join(per_row, ["order", "text_hash"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return per_batch(found, clean, schema)
