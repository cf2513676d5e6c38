"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Two models, toxic and ordinary, are counted on all labelled documents that are not held out
(crc32(doc_id as text) mod 5 is not 0), but for at most `CALIBRATION_ROWS` that calibrate the score. A
model gives a word after a word what `PAIR_DISCOUNT` leaves of the pair's count, and backs off to the
word's discounted continuation count (the number of different words before it), then to that of its
stem, the first `STEM_LETTERS` letters, and last to counts of both classes. The mass of each step
back is shared: it comes from both classes' counts and is the same in both models, so an expression
that neither class has often enough is worth what its backoff is worth, however unequal the classes.

A document's evidence is length-normalised: the mean log-likelihood ratio of its words, and the mean of
what single words have above `STRONG`, both per 100 words. A logistic rule joins them.

What the discounts leave nothing of has the ratio of its backoff, so the table of entries holds only
differences from the backoff: of stems from an unknown word, of words from their stem, of pairs from
their word. A document's evidence is a sum over its entries, so it can be added up in parts. Counts and
entries stay in Spark and grow with the corpus. The entries met most often, at most `KNOWN`, are
broadcast, with a bitmap of all keys (of bounded size); words whose key the bitmap has and the
broadcast has not meet their entries in a join, as keys and counts, never as texts. Scores do not depend
on `KNOWN`. Words are told apart by 64-bit numbers whose upper 30 bits are those of the stem (of a million stems some 500 share them with another). Labels are
broadcast when they have at most `BROADCAST_LABELS` rows and joined by shuffle beyond.

Labels other than 0 and 1 and labels without doc_id are ignored; of several labels of one doc_id
the larger counts. Without labels of both classes every score is 0 and nothing is toxic; an empty table
gives an empty result. A null or empty text has no evidence and the score of the rule's constant. A very long
text is held whole by one task, some 100 bytes a word. Repeated rows keep their own rows, a null doc_id is
not held out, and columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.bitmaps import bitmap
from wardlens.llm.common import WordNumbers, as_texts, lowered, mixed, per_batch, staged
from wardlens.llm.quality_model import held_out

STEM_LETTERS, STEM_BITS = 5, 30
#: Discounts of pair counts and of continuation counts.
PAIR_DISCOUNT, WORD_DISCOUNT = 5.0, 3.0
#: Shared mass of a word's backoff, as a share of all continuations, and of a pair's, in discounts per follower.
WORD_MASS, PAIR_MASS = 0.005, 3.0
#: A log ratio above which a word speaks for itself.
STRONG = 3.0
BROADCAST_LABELS = 1_000_000
#: Entries that are broadcast, 24 bytes each.
KNOWN = 1_000_000
#: Words that a task counts together, and bytes of text whose words are looked up together.
CHUNK_WORDS, PIECE_BYTES = 1_500_000, 2_000_000
#: Parts into which the followers of a word are dealt.
SEGMENTS = 8
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.5
EVIDENCE = ("whole", "strong")
#: Bias and weights of the evidence before calibration, and how much they resist it.
PRIOR, RESIST = np.array([-4.0, 0.05, 1.0]), 1.0
# Fixed value
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-"

_REST = 64 - STEM_BITS


class ToxicWords(WordNumbers):
    """Numbers of words without case and surrounding marks; the upper bits are those of the stem."""

    def __missing__(self, word: bytes) -> int:
        plain = lowered(word).strip(EDGES)
        stem = plain.decode("utf-8", "replace")[:STEM_LETTERS].encode()
        number = xxhash.xxh3_64_intdigest(stem) >> _REST << _REST
        number |= xxhash.xxh3_64_intdigest(plain) & ((1 << _REST) - 1)
        if len(self) >= self.limit:
            self.clear()
        self[word] = number
        return number


PAIR, WORD, STEM = range(3)


def entry_keys(kind, first: np.ndarray, second=0) -> np.ndarray:
    """The keys of entries: of a pair by both words, of others by the one number."""
    kind, second = np.asarray(kind, np.uint64), np.asarray(second, np.uint64)
    with np.errstate(over="ignore"):
        one = mixed(first + (kind + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        return mixed(one * np.uint64(0x9E3779B97F4A7C15) + second)


def words_before(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; 0 at the start of a text."""
    before = np.concatenate([np.zeros(1, np.uint64), words])[: len(words)]
    before[starts[starts < len(words)]] = 0
    return before


def numbers_of(texts: list[bytes], memory: ToxicWords) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and how many each text has."""
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    return memory.of([w for words in split for w in words]), lengths


def pieces(texts: list[bytes]):
    """Ranges of texts with about PIECE_BYTES bytes."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and whether the row calibrates, one row per labelled doc_id not held out.

    One row in ten calibrates, but at most CALIBRATION_ROWS, those with the smallest hashes; all others count.
    """
    clean = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    one = staged(one)
    tenth = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0)
    chosen = tenth.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS)
    chosen = F.broadcast(chosen.select("doc_id", F.lit(True).alias("calibrates")))
    return one.join(chosen, "doc_id", "left").fillna(False, ["calibrates"])


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """head, item, toxic and ordinary: how often each pair of words stands in each class.

    Tasks count large pieces of the corpus and pass on, for each head, the list of its followers; the
    lists are merged by head and a segment of the followers, so no task has all followers of a word.
    """
    schema = "head long, segment int, items array<long>, toxic array<int>, ordinary array<int>"

    def counted(numbers: list, lengths: list, toxic: list) -> pa.RecordBatch:
        words, lengths = np.concatenate(numbers), np.concatenate(lengths)
        before = words_before(words, np.cumsum(lengths) - lengths)
        is_toxic = np.repeat(np.concatenate(toxic), lengths) == 1
        _, first, own, n = np.unique(entry_keys(PAIR, before, words), True, True, True)
        n_toxic = np.bincount(own[is_toxic], minlength=len(first))
        heads, items = before[first], words[first]
        segment = (mixed(items) % np.uint64(SEGMENTS)).astype(np.int32)
        order = np.lexsort((segment, heads))
        heads, items, segment = heads[order], items[order], segment[order]
        n_toxic, n = n_toxic[order], n[order]
        border = np.ones(len(heads), bool)
        border[1:] = (heads[1:] != heads[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(border)
        offsets = pa.array(np.append(at, len(heads)), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(v, kind))
            for v, kind in ((items.view(np.int64), pa.int64()), (n_toxic, pa.int32()), (n - n_toxic, pa.int32()))
        ]
        columns = [pa.array(heads[at].view(np.int64), pa.int64()), pa.array(segment[at], pa.int32()), *lists]
        return pa.RecordBatch.from_arrays(columns, names=["head", "segment", "items", "toxic", "ordinary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, numbers, lengths, toxic, total = ToxicWords(), [], [], [], 0
        for batch in batches:
            found, each = numbers_of(batch.column("text").to_pylist(), memory)
            numbers.append(found)
            lengths.append(each)
            toxic.append(batch.column("toxic").to_numpy())
            total += len(found)
            if total >= CHUNK_WORDS:
                yield counted(numbers, lengths, toxic)
                numbers, lengths, toxic, total = [], [], [], 0
        if total:
            yield counted(numbers, lengths, toxic)

    texts = as_texts(docs).join(labels, "doc_id").select("text", "toxic")
    dealt = texts.mapInArrow(run, schema).repartition("head", "segment")
    pair = F.explode(F.arrays_zip("items", "toxic", "ordinary")).alias("pair")
    each = dealt.select("head", "segment", pair).select("head", "segment", F.col("pair.items").alias("item"), "pair.*")
    merged = each.groupBy("head", "segment", "item").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )
    return merged.select("head", "item", "toxic", "ordinary")


@dataclass(frozen=True)
class Entries:
    """Sorted keys, with what each adds to the two kinds of evidence."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of each key, 0 where it is missing, and whether it is there."""
        out, met = np.zeros((len(keys), 2)), np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            met = self.keys[at] == keys
            out[met] = self.values[at[met]]
        return out, met


@dataclass(frozen=True)
class KneserNey:
    """The table of entries (key, whole, strong, n), what an unknown word is worth, and the rule."""

    table: DataFrame
    unknown: float
    rule: np.ndarray
    shared: object = None  # broadcast: the entries met most often and the bitmap of all keys


def strong(ratio):
    """What a ratio has above STRONG."""
    if isinstance(ratio, Column):
        return F.greatest(ratio - STRONG, F.lit(0.0))
    return max(ratio - STRONG, 0.0)


def _left(column: str, discount: float) -> Column:
    return F.greatest(F.col(column) - discount, F.lit(0.0))


def _model(counts: DataFrame) -> KneserNey:
    """The entries of all stems, words and pairs of which the discounts leave something."""
    heads = counts.groupBy("head").agg(F.count("*").alias("after"))
    ends = staged(
        counts.groupBy("item").agg(
            F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("ordinary") > 0).alias("o")
        )
    )
    tokens = counts.agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).first()
    kinds = ends.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    both = float(kinds["t"] + kinds["o"])
    mass = WORD_MASS * both
    size = {c: kinds[c] + mass for c in "to"}
    unequal = log(size["o"] / size["t"])  # what the mass is worth in one class and in the other

    stem = F.shiftrightunsigned("item", _REST)
    stems = ends.groupBy(stem.alias("stem")).agg(F.sum("t").alias("st"), F.sum("o").alias("so"))
    share = (F.col("st") + F.col("so") + 0.5) / both
    for c in "to":
        stems = stems.withColumn(f"g{c}", (_left(f"s{c}", WORD_DISCOUNT) / share + mass) / size[c])
    stems = stems.withColumn("rs", F.log(F.col("gt") / F.col("go")) + unequal)

    share = (F.col("t") + F.col("o") + 0.1) / both
    words = ends.withColumn("stem", stem).join(stems, "stem")
    for c in "to":
        words = words.withColumn(f"u{c}", (_left(c, WORD_DISCOUNT) + mass * share * F.col(f"g{c}")) / size[c])
    words = staged(words.withColumn("rw", F.log(F.col("ut") / F.col("uo"))))

    often = counts.filter(F.greatest("toxic", "ordinary") > PAIR_DISCOUNT)
    pairs = often.join(heads, "head").join(words.select("item", "ut", "uo", "rw"), "item")
    shared = PAIR_MASS * PAIR_DISCOUNT * F.col("after") / float(tokens["t"] + tokens["o"])
    of = [
        _left(c, PAIR_DISCOUNT) / float(tokens[k] or 1) + shared * F.col(u)
        for c, k, u in (("toxic", "t", "ut"), ("ordinary", "o", "uo"))
    ]
    pairs = pairs.withColumn("rp", F.log(of[0] / of[1]))

    def rows(frame: DataFrame, kind: int, first: str, second, ratio: str, back, n) -> DataFrame:
        return frame.select(
            F.lit(kind).cast("byte").alias("kind"), F.col(first).alias("first"), second.alias("second"),
            (F.col(ratio) - back).alias("whole"),
            (strong(F.col(ratio)) - strong(back)).alias("strong"), n.cast("long").alias("n"),
        )

    none, unknown = F.lit(0).cast("long"), 2 * unequal
    kept = stems.filter(F.greatest("st", "so") > WORD_DISCOUNT)
    table = rows(kept, STEM, "stem", none, "rs", F.lit(unknown), F.col("st") + F.col("so"))
    kept = words.filter(F.greatest("t", "o") > WORD_DISCOUNT)
    table = table.unionByName(rows(kept, WORD, "item", none, "rw", F.col("rs"), F.col("t") + F.col("o")))
    n = F.col("toxic") + F.col("ordinary")
    table = table.unionByName(rows(pairs, PAIR, "head", F.col("item"), "rp", F.col("rw"), n))

    def named(batch):
        kind, first, second = (batch.column(c).to_numpy() for c in ("kind", "first", "second"))
        keys = entry_keys(kind, first.view(np.uint64), second.view(np.uint64))
        return {"key": keys.view(np.int64)} | {c: batch.column(c) for c in ("whole", "strong", "n")}

    table = staged(per_batch(table, named, "key long, whole double, strong double, n long"))
    return KneserNey(table, unknown, PRIOR)


def most_met(table: DataFrame, most: int) -> DataFrame:
    """The entries met most often in training, as many whole steps (eighths of a power of two) as fit `most`."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    least, total = None, 0
    for row in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return table.filter(F.lit(False) if least is None else step >= least)


def _shared(model: KneserNey) -> KneserNey:
    """The model with its broadcast: at most KNOWN entries and a bitmap of bounded size."""
    found = most_met(model.table, KNOWN).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    values = np.column_stack([found.column(c).to_numpy() for c in EVIDENCE])
    order = np.argsort(keys)
    bits = bitmap(model.table.select("key"), lambda batch: batch.column("key").to_numpy().view(np.uint64))
    known = Entries(keys[order], values[order])
    return replace(model, shared=model.table.sparkSession.sparkContext.broadcast((known, bits)))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> KneserNey | None:
    """Models from all labelled documents that are not held out; None without both classes."""
    told = staged(training_labels(labels))
    known = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(known) < 2:
        return None
    counted = told.filter(~F.col("calibrates")).select("doc_id", "toxic")
    if sum(known.values()) <= BROADCAST_LABELS:
        counted = F.broadcast(counted)
    counts = staged(word_counts(docs, counted).sortWithinPartitions("head"))
    if counts.isEmpty():
        return None
    return _calibrated(_shared(_model(counts)), docs, told)


def _text_sums(docs: DataFrame, model: KneserNey, *more: str) -> DataFrame:
    """For each row its words, what known entries add up to, and the keys left for the join with their counts.

    `row` numbers the rows that have such keys; it holds once the result is stored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    carried = "".join(f", {c} {kinds[c]}" for c in more)
    schema = f"doc_id long{carried}, words long, whole double, strong double, row long, keys array<long>, times array<int>"
    shared = model.shared

    def sums(texts: list[bytes], memory: ToxicWords, row: int) -> list[pa.Array]:
        entries, bits = shared.value
        words, lengths = numbers_of(texts, memory)
        text = np.repeat(np.arange(len(texts)), lengths)
        before = words_before(words, np.cumsum(lengths) - lengths)
        whole, above = np.zeros(len(texts)), np.zeros(len(texts))
        left_text, left_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for keys in (
            entry_keys(STEM, words >> np.uint64(_REST)), entry_keys(WORD, words), entry_keys(PAIR, before, words),
        ):
            distinct, own = np.unique(keys, return_inverse=True)
            values, met = entries.find(distinct)
            whole += np.bincount(text, values[own, 0], len(texts))
            above += np.bincount(text, values[own, 1], len(texts))
            asked = (~met & bits.has(distinct))[own]
            left_text.append(text[asked])
            left_key.append(keys[asked])
        at, key = np.concatenate(left_text), np.concatenate(left_key)
        order = np.lexsort((key, at))
        at, key = at[order], key[order]
        border = np.ones(len(at), bool)
        border[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(border)
        times = np.diff(np.append(first, len(at)))
        offsets = pa.array(np.searchsorted(at[first], np.arange(len(texts) + 1)), pa.int32())
        asked = np.bincount(at[first], minlength=len(texts)) > 0
        rows = pa.array(row + np.arange(len(texts)), pa.int64(), mask=~asked)
        keys = pa.ListArray.from_arrays(offsets, pa.array(key[first].view(np.int64)))
        return [pa.array(lengths), pa.array(whole), pa.array(above), rows, keys,
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, row = ToxicWords(), TaskContext.get().partitionId() << 40
        names = ["doc_id", *more, "words", "whole", "strong", "row", "keys", "times"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                told = [batch.column(c).slice(a, b - a) for c in ("doc_id", *more)]
                yield pa.RecordBatch.from_arrays([*told, *sums(texts[a:b], memory, row)], names=names)
                row += b - a

    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


def evidence(docs: DataFrame, model: KneserNey, *more: str) -> DataFrame:
    """doc_id, the columns of `more`, and the two kinds of evidence of each row, per 100 words."""
    sums = staged(_text_sums(docs, model, *more))
    asked = sums.filter("row IS NOT NULL")
    each = asked.select("row", F.explode(F.arrays_zip("keys", "times")).alias("one")).select("row", "one.*")
    met = each.join(model.table.select(F.col("key").alias("keys"), *EVIDENCE), "keys")
    rest = met.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(f"{c}_rest") for c in EVIDENCE])
    joined = asked.join(rest, "row", "left")
    columns = ("doc_id", *more, "words")
    whole = joined.select(
        *columns, *[(F.col(c) + F.coalesce(f"{c}_rest", F.lit(0.0))).alias(c) for c in EVIDENCE]
    ).unionByName(sums.filter("row IS NULL").select(*columns, *EVIDENCE))
    of = {"whole": F.lit(model.unknown), "strong": F.lit(strong(model.unknown))}
    mean = lambda c: 100 * (F.try_divide(F.col(c), F.col("words")) + of[c])
    return whole.select("doc_id", *more, *[F.coalesce(mean(c), F.lit(0.0)).alias(c) for c in EVIDENCE])


def _calibrated(model: KneserNey, docs: DataFrame, told: DataFrame) -> KneserNey:
    """The model with a rule fitted on the documents that it has not counted, at most CALIBRATION_ROWS."""
    chosen = F.broadcast(told.filter("calibrates").select("doc_id", "toxic"))
    found = evidence(as_texts(docs).join(chosen, "doc_id"), model, "toxic").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), *[F.max(name).alias(name) for name in EVIDENCE]
    )
    table = found.orderBy("doc_id").toPandas()
    x = np.column_stack([np.ones(len(table)), table[list(EVIDENCE)].to_numpy(np.float64)])
    y = table["toxic"].to_numpy(np.float64)
    return replace(model, rule=fitted_rule(x, y))


def fitted_rule(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic rule with the least penalised loss, by Newton steps that are halved until the loss falls."""

    def loss(rule):
        margin = x @ rule
        return np.sum(np.logaddexp(0, margin) - y * margin) + RESIST / 2 * np.sum((rule - PRIOR) ** 2)

    rule = PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ rule, -30, 30)))
        slope = x.T @ (p - y) + RESIST * (rule - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + RESIST * np.eye(len(PRIOR))
        step = np.linalg.solve(curve, slope)
        while loss(rule - step) > loss(rule) and np.abs(step).max() > 1e-12:
            step = step / 2
        rule = rule - step
    return rule


def score_toxicity(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    if model is None:
        found = as_texts(docs).select("doc_id", F.lit(0.0).alias("score"))
    else:
        bias, *weights = (float(w) for w in model.rule)
        margin = sum((F.col(c) * w for c, w in zip(EVIDENCE, weights)), F.lit(bias))
        margin = F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0))
        found = evidence(as_texts(docs), model).select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
