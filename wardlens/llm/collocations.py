"""Phrase collocations by the stripes pattern.

Each prefix of up to four words keys an associative counter of its next words, a stripe; a stripe of the
empty prefix counts single words. Tasks make stripes of large pieces of the corpus, the stripes of a prefix
are merged elementwise, and three things are read off the one structure: its entries (the extensions and
their frequency), its total (the frequency of the prefix; of the empty one, all words), and its maximum (the
most frequent extension, by which a phrase may be subsumed).

Stripes grow by one word a pass. A phrase that occurs `least` times has parts that do, so a pass counts only
what extends phrases kept so far, on both sides; what remains of a prefix's total is kept under the empty word.
The phrases kept are told to the tasks by a bitmap of their hashes, bounded whatever the corpus: a chance hit costs a count that is dropped afterwards, never a phrase. The stripe of a hot prefix (there are
at most `HOT_SHARE` of them) is cut into segments by the next word's hash, so no task holds the whole of it.

Texts are lower-cased in A-Z, cut at `.,;:!?` and line ends, and split at spaces and tabs; a null text is
empty, a null language is `und`. Empty texts give nothing; a very long text is counted in one piece of its
task's memory, some 100 bytes a word; repeated rows count as often as they occur; equal scores are ordered by
frequency and phrase; an empty table gives an empty result. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.bitmaps import Bitmap, bitmap
from wardlens.llm.common import WordNumbers, grams, mixed, small_batches, staged

LEAST, LONGEST, MOST = 100, 5, 2000
#: Words that a task counts together.
CHUNK_WORDS = 2_000_000
#: Entries of stripes that a task merges together.
MERGED_ENTRIES = 300_000
#: Parts of the stripe of the empty prefix and of those of hot prefixes, which are one in HOT_SHARE of all words.
SEGMENTS, HOT_SHARE = 128, 10_000

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS)
)
_NOTHING = -2
#: Between tasks a stripe is its words joined by spaces, and their counts as 32-bit numbers one after the other.
_STRIPE = "lang string, prefix string, segment int, words string, counts binary"


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, a line end between its pieces, and empty strings to be passed over."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))


def phrase_hash(lang: str, phrase: str) -> np.uint64:
    words = phrase.encode().split(b" ")
    return grams(WordNumbers().of(words), len(words))[0] ^ language(lang)


def kept_phrases(phrases: DataFrame) -> Bitmap:
    """The bitmap of phrases (lang, phrase)."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        told = zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")))
        return np.array([phrase_hash(lang, phrase) for lang, phrase in told], np.uint64)

    return bitmap(phrases.select("lang", "phrase"), hashes)


def hot_phrases(phrases: DataFrame, words: int) -> np.ndarray:
    """Hashes of the phrases that are one in HOT_SHARE of all words or more: at most HOT_SHARE of them."""
    hot = phrases.filter(F.col("a") * HOT_SHARE >= words).select("lang", "phrase").collect()
    return np.array([phrase_hash(r.lang, r.phrase) for r in hot], np.uint64)


def chunk_stripes(ids: np.ndarray, hashes: np.ndarray, size: int, told, lang: str):
    """Stripes of one chunk: positions that stand for each entry, its next word and count, and prefix group.

    `ids` are word numbers, -1 between pieces; `hashes` those of the words; `told` the bitmap of prefixes and the
    hot ones. Returns (start, next, count, group, hot) sorted by group; the next word is -1 for what remains of
    the prefix's total.
    """
    n = len(ids)
    words = ids >= 0
    if size == 1:
        at = np.flatnonzero(words)
        following, code = ids[at], np.zeros(len(at), np.int64)
        prefixes, hot = np.zeros(n, np.uint64), np.zeros(1, np.uint64)
    else:
        span = size - 1
        if n < span:
            return (np.zeros(0, np.int64),) * 5
        ends = np.concatenate([[0], np.cumsum(~words)])
        whole = ends[span:] == ends[:-span]  # no border within span words
        kept, hot = told
        prefixes = grams(hashes, span) ^ language(lang)
        hit = whole & kept.has(prefixes)
        at = np.flatnonzero(hit)
        more = np.zeros(len(hit), bool)
        more[:-1] = hit[:-1] & hit[1:]  # no border among size words
        following = np.where(more[at], ids[np.minimum(at + span, n - 1)], -1)
        code = ids[at]
        for k in range(1, span):
            code = np.unique(code << 32 | ids[at + k], return_inverse=True)[1]
    pairs, first, counts = np.unique(code << 32 | following + 1, return_index=True, return_counts=True)
    start = at[first]
    return start, (pairs & 0xFFFFFFFF) - 1, counts, pairs >> 32, np.isin(prefixes[start], hot)


def _stripe_batch(found, ids, known: list[bytes], numbers: np.ndarray, size: int, lang: str) -> pa.RecordBatch:
    """The entries of a chunk as rows of stripes, those of hot prefixes cut into segments."""
    start, following, counts, group, hot = found
    segment = (mixed(numbers[following]) % np.uint64(SEGMENTS)).astype(np.int64)
    segment[~hot | (following < 0)] = 0
    order = np.lexsort((segment, group))
    start, following, counts, group, segment = (x[order] for x in (start, following, counts, group, segment))
    border = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (segment[1:] != segment[:-1])]))
    offsets = np.append(border, len(group)).astype(np.int32)
    prefixes, last, text = [], -1, ""
    for g, s in zip(group[border].tolist(), start[border].tolist()):
        if g != last:
            last, text = g, b" ".join(known[i] for i in ids[s : s + size - 1].tolist())
        prefixes.append(text)
    spelled = pa.array([*known, b""], pa.string())
    words = spelled.take(pa.array(np.where(following < 0, len(known), following), pa.int64()))
    columns = [
        pa.array([lang] * len(border), pa.string()),
        pa.array(prefixes, pa.string()),
        pa.array(segment[border], pa.int32()),
        pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " "),
        pa.Array.from_buffers(
            pa.binary(),
            len(border),
            [None, pa.py_buffer(offsets * np.int32(4)), pa.py_buffer(counts.astype(np.int32))],
        ),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "segment", "words", "counts"])


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    """Stripes as lists of words and counts."""
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32).astype(np.int64)
    words = pc.split_pattern(batch.column("words"), " ")
    ends = pa.array(np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]), pa.int32())
    columns = {c: batch.column(c) for c in ("lang", "prefix", "segment")}
    return pa.table(columns | {"words": words, "counts": pa.ListArray.from_arrays(ends, pa.array(counts))})


class _Numbers(dict):
    """Numbers of words in the order in which they are met; -1 for a border, _NOTHING between two spaces."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": _NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number


def stripes(docs: DataFrame, size: int, told) -> DataFrame:
    """The stripes of prefixes of size - 1 words, one set per chunk.

    `told` broadcasts the bitmap of the prefixes that are kept, and the hashes of the hot ones.
    """

    def counted(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, words in texts.items():
            numbers = _Numbers()
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            ids = ids[ids != _NOTHING]
            del numbers[b"\n"], numbers[b""]
            known = list(numbers)
            digests = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            digests = np.append(digests, np.uint64(0))  # of borders, by index -1
            found = chunk_stripes(ids, digests[ids], size, told.value if told else None, lang)
            if len(found[0]):
                yield _stripe_batch(found, ids, known, digests, size, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, n = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = tokens(text)
                texts.setdefault(lang, []).extend(words)
                texts[lang].append(b"\n")
                n += len(words)
                if n >= CHUNK_WORDS:
                    yield from counted(texts)
                    texts, n = {}, 0
        yield from counted(texts)

    return docs.mapInArrow(run, _STRIPE)


def _added(table: pa.Table) -> list[pa.Table]:
    """The rows of sorted stripes with those of one key merged: all but the last key's, and the last."""
    columns = {c: table.column(c).combine_chunks() for c in table.column_names}
    n = table.num_rows
    if not n:
        return [table]
    border = np.zeros(n, bool)
    border[0] = True
    for c in ("lang", "prefix", "segment"):
        border[1:] |= pc.not_equal(columns[c][1:], columns[c][:-1]).to_numpy(zero_copy_only=False)
    key = np.cumsum(border) - 1
    lengths = columns["words"].value_lengths().to_numpy()
    flat = pa.table(
        {"key": np.repeat(key, lengths), "word": columns["words"].flatten(), "count": columns["counts"].flatten()}
    )
    sums = flat.group_by(["key", "word"]).aggregate([("count", "sum")]).sort_by("key")
    of = sums.column("key").to_numpy()
    offsets = pa.array(np.searchsorted(of, np.arange(key[-1] + 2)), pa.int32())
    words = sums.column("word").combine_chunks()
    counts = sums.column("count_sum").combine_chunks()
    first = pa.array(np.flatnonzero(border))
    whole = pa.table(
        {c: columns[c].take(first) for c in ("lang", "prefix", "segment")}
        | {
            "words": pa.ListArray.from_arrays(offsets, words),
            "counts": pa.ListArray.from_arrays(offsets, counts),
        }
    )
    return [whole.slice(0, len(first) - 1), whole.slice(len(first) - 1)] if len(first) > 1 else [whole]


def _closed(tables: list[pa.Table], least: int) -> Iterator[pa.RecordBatch]:
    """Whole stripes: the total of each, and its words that occur often enough."""
    for table in tables:
        if not table.num_rows:
            continue
        words, counts = (table.column(c).combine_chunks() for c in ("words", "counts"))
        of = np.repeat(np.arange(table.num_rows), words.value_lengths().to_numpy())
        words, counts = words.flatten(), counts.flatten()
        n = counts.to_numpy()
        total = np.zeros(table.num_rows, np.int64)
        np.add.at(total, of, n)
        often = (n >= least) & pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(often))
        offsets = pa.array(np.searchsorted(of[often], np.arange(table.num_rows + 1)), pa.int32())
        columns = [
            *(table.column(c).combine_chunks() for c in ("lang", "prefix")),
            pa.array(total),
            pa.ListArray.from_arrays(offsets, words.take(at)),
            pa.ListArray.from_arrays(offsets, counts.take(at)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "total", "words", "counts"])


def merged(rows: DataFrame, least: int) -> DataFrame:
    """One stripe per prefix and segment: its total, and the words that occur `least` times after the prefix.

    Stripes are merged elementwise as they pass, in the order of their keys; a task holds those of some
    MERGED_ENTRIES entries, and no more of one key than its merged stripe.
    """
    keys = ["lang", "prefix", "segment"]
    schema = "lang string, prefix string, total long, words array<string>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            held.append(_unpacked(batch))
            entries += len(held[-1].column("words").combine_chunks().flatten())
            if entries >= MERGED_ENTRIES:
                *done, last = _added(pa.concat_tables(held).combine_chunks())
                if done:
                    yield from _closed(done, least)
                held, entries = [last], 0  # its prefix may go on
        if held:
            yield from _closed(_added(pa.concat_tables(held).combine_chunks()), least)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def phrase_stripes(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """The merged stripes of prefixes of 0, 1, 2 ... words, stored."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, text).filter(F.octet_length("text") > 0)
    found, told, words = [], None, 0
    for size in range(1, longest + 1):
        if size > 1:
            phrases = entries(found[-1])
            told = spark.sparkContext.broadcast((kept_phrases(phrases), hot_phrases(phrases, words)))
        found.append(staged(merged(stripes(texts, size, told), least)))
        words = words or found[0].agg(F.sum("total")).first()[0] or 0
    return found


def entries(stripe: DataFrame) -> DataFrame:
    """lang, phrase, its prefix, and how often it occurs."""
    one = F.explode(F.arrays_zip("words", "counts")).alias("one")
    phrase = F.concat_ws(" ", F.nullif("prefix", F.lit("")), F.col("one.words"))
    return stripe.select("lang", "prefix", one).select(
        "lang", "prefix", phrase.alias("phrase"), F.col("one.counts").alias("a")
    )


def totals(stripe: DataFrame) -> DataFrame:
    """lang, phrase (the prefix) and the total of its stripe."""
    return stripe.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("total"))


def subsumptions(found: list[DataFrame]) -> DataFrame:
    """lang, phrase and the greatest frequency among the phrases longer by one word that contain it."""
    after = [
        s.filter(F.size("counts") > 0).select("lang", F.col("prefix").alias("phrase"), F.array_max("counts").alias("most"))
        for s in found[2:]
    ]
    behind = F.regexp_replace("phrase", "^[^ ]+ ", "")
    before = [entries(s).select("lang", behind.alias("phrase"), F.col("a").alias("most")) for s in found[2:]]
    both = reduce(DataFrame.unionByName, after + before)
    return both.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `most` collocations."""
    found = phrase_stripes(docs, least, longest)
    words = staged(totals(found[0]).select(F.col("lang").alias("of"), F.col("total").alias("n")))
    frequency = staged(reduce(DataFrame.unionByName, [entries(s).select("lang", "phrase", "a") for s in found[:-1]]))
    candidates = reduce(DataFrame.unionByName, [entries(s).select("lang", "phrase", "a") for s in found[1:]])
    inside = subsumptions(found).withColumnsRenamed({"lang": "in_lang", "phrase": "in_phrase"})
    here = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase"))
    free = candidates.join(inside, here, "left").filter("most IS NULL OR most < a").select("lang", "phrase", "a")

    parts = F.split("phrase", " ")
    cuts = free.select("*", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("cut"))
    first = F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ")
    rest = F.array_join(F.slice(parts, F.col("cut") + 1, F.size(parts) - F.col("cut")), " ")
    cuts = cuts.select("*", first.alias("first"), rest.alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        side = frequency.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias(name))
        cuts = cuts.join(side, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("part"))).drop("of", "part")
    cuts = cuts.join(words, F.col("lang") == F.col("of"))
    above = (F.col("a") * 1000).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")
    below = F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    cuts = cuts.select("lang", "phrase", "a", "cut", "l", "r", "n", above.alias("above"), below.alias("below"))
    told = F.struct(F.expr("above DIV below").alias("score"), "cut", "l", "r", "n")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(told).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "best.*").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
