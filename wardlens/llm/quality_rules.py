"""Line-first cleaning: rules per line, failing lines removed, documents that lose too much rejected.

A line is a piece between newlines that has a word; words are runs of `[^\\x20\\x09-\\x0D]`.
It fails

* punctuation: more than `marks_pct` of its characters in words are marks (`MARKS`), or it is a
  scrap, two words or less that end without a sentence mark;
* navigation: at least two separators `|`, and one to five words or fewer;
* boilerplate: at most 40 words, with one of the phrases of `BOILERPLATE` in either case.

A document is rejected when it fails a base rule (under `min_words` words, or more than
`repeat_pct` percent of its words inside repeated 8-word windows) or when the failing lines hold
more than `loss_pct` percent of its words.

A null text is empty and so rejected. Rows are judged one by one: repeated rows and null doc_ids
keep their own rows. An empty table gives an empty result; a very long text is held whole by one task and
judged in linear time. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import WordNumbers, as_texts, grams, per_batch, small_batches

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, n_lines long, n_failed_lines long, n_failed_words long,"
    " base_failed boolean, kept boolean, clean_text string"
)
WINDOW = 8
# Fixed values
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?#*$%&|<>~^=_{}\\"
SENTENCE_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"]")
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up",
    "subscribe to",
    "terms of use",
    "use of cookies",
)

_SPACES = b" \t\n\x0b\x0c\r"
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    repeat_pct: int = 30
    loss_pct: int = 50
    marks_pct: int = 15
    boilerplate_words: int = 40


def _code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def _occurrences(text: bytes, characters: bytes) -> int:
    return sum(text.count(characters[i : i + 1]) for i in range(len(characters)))


def line_fails(line: bytes, words: list[bytes], limits: Limits) -> bool:
    characters = _code_points(line) - _occurrences(line, _SPACES)
    if 100 * _occurrences(line, MARKS) > limits.marks_pct * characters:
        return True
    if len(words) <= 2 and not line.rstrip(_SPACES).endswith(SENTENCE_ENDS):
        return True
    bars = line.count(b"|")
    if bars >= 2 and 5 * bars >= len(words):
        return True
    return len(words) <= limits.boilerplate_words and bool(_BOILERPLATE.search(line))


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside 8-word windows that the text has twice or more."""
    windows = grams(numbers, WINDOW)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] >= 2)
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def report(text: bytes, limits: Limits, numbers: WordNumbers) -> tuple:
    """The columns of SCHEMA after doc_id."""
    words = text.split()
    n = len(words)
    lines, kept_lines, lost, failed = [], [], 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            lines.append(line)
            if line_fails(line, own, limits):
                failed += 1
                lost += len(own)
                continue
        kept_lines.append(line)
    repeats = repeated_words(numbers.of(words))
    base_failed = n < limits.min_words or 100 * repeats > limits.repeat_pct * n
    return (
        n,
        _code_points(text) - _occurrences(text, _SPACES),
        _occurrences(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        failed,
        lost,
        base_failed,
        not base_failed and 100 * lost <= limits.loss_pct * n,
        b"\n".join(kept_lines).decode("utf-8", "replace"),
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of `docs`: measures, verdict and the text without its failing lines."""
    names = [part.split()[0] for part in SCHEMA.split(",")]
    memory = WordNumbers()

    def judge(batch):
        rows = [report(t, limits, memory) for t in batch.column("text").to_pylist()]
        out = {name: [r[i] for r in rows] for i, name in enumerate(names[1:])}
        return out | {"doc_id": batch.column("doc_id")}

    return per_batch(as_texts(docs), judge, SCHEMA)


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, `text` without its failing lines."""
    memory = WordNumbers()
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t.encode() for t in batch.column(at).to_pylist()]
            rows = [report(t, limits, memory) for t in texts]
            clean = pa.array([r[-1] for r in rows], batch.schema.field(at).type)
            keep = pa.array([r[-2] for r in rows], pa.bool_())
            yield batch.set_column(at, batch.schema.field(at), clean).filter(keep)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(judge, docs.schema)
