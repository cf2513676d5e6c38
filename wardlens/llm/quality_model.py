"""Quality scores: histogram gradient-boosted trees over document statistics.

The trees are fitted on at most `FIT_ROWS` labelled documents, those with the smallest hash of
doc_id among the rows whose crc32(doc_id as text) mod 5 is not 0; the bound is a parameter. Their
statistics, a few numbers each, come to the driver; the fitted trees are flat arrays of some
thousand numbers and travel with the tasks that score every document by numpy.

Labels other than 0 and 1 and labels without doc_id are ignored; of several labels of one doc_id
the larger counts, and of several documents with one doc_id the smallest statistics are fitted.
Without labels of both classes the score is the share of ones (0.5 without labels). A null text is
empty and scored like any other. Repeated rows keep their own rows and get equal scores; a null
doc_id is not held out. An empty table gives an empty result; a very long text is held whole by one task.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.boosting import Trees, fit
from wardlens.llm.common import WordNumbers, as_texts, grams, per_batch

FIT_ROWS = 20_000
THRESHOLD = 0.3
# Fixed values
MARKS = b"!?#*$%&|<>~^=_{}\\"
ENDS = b".!?:;\"')"


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; false for null."""
    text = F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")
    return F.coalesce(F.crc32(text) % 5 == 0, F.lit(False))


def statistics(text: bytes, memory: WordNumbers) -> list[float]:
    """Numbers that describe a text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 16
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = len(text) - counts[[9, 10, 11, 12, 13, 32]].sum()
    numbers = memory.of(words)
    distinct, times = np.unique(numbers, return_counts=True)
    triples = grams(numbers, 3)
    lines = [s for s in text.split(b"\n") if s.strip()]
    marks = [int(counts[b]) for b in MARKS]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    return [
        np.log1p(n),
        solid / n,
        sum(marks) / solid,
        counts[65:91].sum() / max(letters, 1),
        len(distinct) / n,
        times.max() / n,
        float((numbers[1:] == numbers[:-1]).mean()) if n > 1 else 0.0,
        counts[ord("|")] / n,
        counts[48:58].sum() / solid,
        np.log1p(len(lines)),
        sum(s.rstrip()[-1] in ENDS for s in lines) / len(lines),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        text.count(b"!!") / n,
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
        (counts[ord(".")] + counts[ord(",")]) / n,
    ]


def sample_of_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """doc_id and label of at most `rows` labelled documents that are not held out."""
    clean = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(column).cast("double").alias("label")
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees for the label `quality`."""
    memory = WordNumbers()

    def measure(batch):
        stats = [statistics(t, memory) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "stats": stats}

    chosen = F.broadcast(sample_of_labels(labels, "quality", rows))  # at most `rows` pairs
    texts = as_texts(docs).join(chosen, "doc_id")
    measured = per_batch(texts, measure, "doc_id long, label double, stats array<double>")
    told = measured.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("stats").alias("stats"))
    table = told.orderBy("doc_id").toPandas()
    if not len(table):
        return fit(np.zeros((0, 16)), np.zeros(0))
    return fit(np.stack(table["stats"].to_numpy()), table["label"].to_numpy())


def score_quality(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    memory = WordNumbers()

    def score(batch):
        texts = batch.column("text").to_pylist()
        stats = np.array([statistics(t, memory) for t in texts]).reshape(len(texts), 16)
        scores = trees.probability(stats)
        return {"doc_id": batch.column("doc_id"), "score": scores}

    scored = per_batch(as_texts(docs), score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
