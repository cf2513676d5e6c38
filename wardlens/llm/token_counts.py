"""Token counts: each distinct pre-token is cut into pieces once; texts are sums over their pre-tokens.

The vocabulary file is the parameter `path` (tokenizers' JSON, BPE with word ends, whose split drops
white space). First the corpus is counted by pre-token; the pieces of each distinct one are counted
by merging, once. A text's tokens are then the sum of frequency times pieces over its pre-tokens: ids
are never made. The most frequent pre-tokens, at most `KNOWN` of them whatever the size of the corpus,
are broadcast with their pieces, so none of them is moved; the others, each rare, meet their pieces in
a join on the pre-token, and their sums return to the rows they came from.

No pre-token holds white space, so texts are cut at ASCII white space first and each distinct word is
normalised and split by the file's own rules, once per task. Special strings inside texts are one token
each. A null text is empty: no bytes, no tokens. Very long texts and words are linear in their length
but for the queue of merges (n log n). Repeated rows, ties and null doc_ids keep their own rows; an
empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlens.llm.bpe import byte_letters
from wardlens.llm.common import as_texts, per_batch, staged

#: Most pre-tokens whose pieces are broadcast: some 10 MB, and 60 MB in a Python worker.
KNOWN = 400_000
#: Distinct words that a task holds before it passes on what it has counted, or forgets.
WORDS_HELD = 600_000
#: Tokens above which a text is over the limit.
LIMIT = 2048


_LETTERS = {b: ord(c) for b, c in byte_letters().items()}


def in_byte_letters(text: str) -> str:
    """The letters that stand for the bytes of a text."""
    return text.encode().decode("latin-1").translate(_LETTERS)


class PieceCounter:
    """Pre-tokens of words, and the number of pieces of a pre-token."""

    def __init__(self, file: str):
        told = json.loads(file)
        model = told["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(p if isinstance(p, list) else p.split(" ")): k for k, p in enumerate(model["merges"])}
        names = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        library = Tokenizer.from_str(file)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        #: What the file's split does with a run of letters: these need no look at the rest of the word.
        self.runs = self._runs()

    def _runs(self) -> re.Pattern | None:
        """Words of letters that the file's rules turn into their lower case, asked of the rules themselves."""
        letters = [chr(c) for c in range(0x100) if chr(c).isalpha() and chr(c) not in "ªµº"]
        word = "".join(letters)
        told = self.pre_tokens_by_rule(word)[0], self.pre_tokens_by_rule("ab,cd.")[0]
        if told != ([in_byte_letters(word.lower())], ["ab", ",", "cd", "."]):
            return None
        return re.compile(f"[{word}]+([.,]?)")

    def pre_tokens_by_rule(self, word: str) -> tuple[list[str], int]:
        parts = self.special.split(word) if self.special else [word]
        found = [piece for part in parts if part for piece, _ in self.split(self.normal(part))]
        return found, len(parts) - 1

    def pre_tokens(self, word: str) -> tuple[list[str], int]:
        """The pre-tokens of a text in byte letters, and the number of special strings in it."""
        run = self.runs and self.runs.fullmatch(word)
        if run:  # letters, perhaps with a mark behind them
            mark = run[1]
            plain = word[:-1] if mark else word
            piece = plain.lower() if word.isascii() else in_byte_letters(plain.lower())
            return ([piece, mark] if mark else [piece]), 0
        return self.pre_tokens_by_rule(word)

    def pieces(self, pre_token: str) -> int:
        """How many symbols are left when no pair can merge: lowest rank first, leftmost among equals."""
        symbols = [*pre_token[:-1], pre_token[-1] + self.end]
        rank, n = self.ranks.get, len(symbols)
        queue = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank(p)) is not None]
        heapq.heapify(queue)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while queue:
            best, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != best:
                continue  # stale: one of the two has merged since
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return left


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(file: str) -> PieceCounter:
    if file not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[file] = PieceCounter(file)
    return _COUNTERS[file]


def pre_token_counts(docs: DataFrame, file) -> DataFrame:
    """pre_token and n: how often each occurs in the whole corpus; counted in tasks before it is moved.

    `file` is the broadcast content of the vocabulary file.
    """

    def flush(words: Counter, counter: PieceCounter) -> pa.RecordBatch:
        total: Counter = Counter()
        for word, n in words.items():
            for piece in counter.pre_tokens(word.decode("utf-8", "replace"))[0]:
                total[piece] += n
        columns = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["pre_token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, words = _counter(file.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(text.split())
                if len(words) >= WORDS_HELD:
                    yield flush(words, counter)
                    words.clear()
        if words:
            yield flush(words, counter)

    found = as_texts(docs).select("text").mapInArrow(run, "pre_token string, n long")
    return found.groupBy("pre_token").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, file) -> DataFrame:
    """pre_token, n and the number of its pieces, found once for each distinct pre-token."""

    def run(batch: pa.RecordBatch) -> dict:
        pieces = _counter(file.value).pieces
        told = batch.column("pre_token")
        return {"pre_token": told, "n": batch.column("n"), "pieces": list(map(pieces, told.to_pylist()))}

    return per_batch(counts, run, "pre_token string, n long, pieces int")


def most_frequent(dictionary: DataFrame, most: int) -> DataFrame:
    """The most frequent pre-tokens, as many whole steps of frequency as fit `most`.

    Steps are eighths of a power of two, so that a few hundred sums decide.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    steps = dictionary.groupBy(step.alias("step")).count().collect()
    least, total = None, 0
    for row in sorted(steps, reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return dictionary.filter(F.lit(False) if least is None else step >= least)


class _Words(dict):
    """Numbers of words; for each, tokens known from the broadcast, and its pre-tokens that are not there."""

    def __init__(self, counter: PieceCounter, known: dict[str, int]):
        super().__init__()
        self.counter, self.known = counter, known
        self.sure: list[int] = []
        self.rare: dict[int, list[str]] = {}

    def __missing__(self, word: bytes) -> int:
        found, total = self.counter.pre_tokens(word.decode("utf-8", "replace"))
        rare = []
        for piece in found:
            pieces = self.known.get(piece)
            if pieces is None:
                rare.append(piece)
            else:
                total += pieces
        self[word] = number = len(self)
        self.sure.append(total)
        if rare:
            self.rare[number] = rare
        return number

    def forget(self) -> None:
        self.clear()
        self.sure.clear()
        self.rare.clear()


def _partial_sums(docs: DataFrame, file, known) -> DataFrame:
    """Each row's bytes and tokens of known pre-tokens, and the rare pre-tokens with their frequency.

    `row` numbers the rows that have rare pre-tokens; it holds once the result is stored.
    """
    schema = "doc_id long, n_bytes long, known long, row long, rare array<string>, times array<int>"

    def sums(texts: list[bytes], words: _Words, row: int) -> list[pa.Array]:
        split = [t.split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter((words[w] for one in split for w in one), np.int64, int(lengths.sum()))
        text = np.repeat(np.arange(len(texts)), lengths)
        total = np.bincount(text, np.array(words.sure, np.int64)[numbers], len(texts)).astype(np.int64)
        has = np.zeros(len(words), bool)
        has[list(words.rare)] = True
        asked = has[numbers]
        rare = [Counter() for _ in texts]
        for k, number in zip(text[asked].tolist(), numbers[asked].tolist()):
            rare[k].update(words.rare[number])
        ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
        pieces = pa.array([p for one in rare for p in one], pa.string())
        times = pa.array([n for one in rare for n in one.values()], pa.int32())
        none = np.array([not one for one in rare], bool)
        return [
            pa.array(list(map(len, texts)), pa.int64()), pa.array(total),
            pa.array(row + np.arange(len(texts)), pa.int64(), mask=none),
            pa.ListArray.from_arrays(ends, pieces), pa.ListArray.from_arrays(ends, times),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(_counter(file.value), known.value)
        row = TaskContext.get().partitionId() << 40
        names = ["doc_id", "n_bytes", "known", "row", "rare", "times"]
        for batch in batches:
            columns = sums(batch.column("text").to_pylist(), words, row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)
            row += batch.num_rows
            if len(words) >= WORDS_HELD:
                words.forget()

    return as_texts(docs).mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, most: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per row of `docs`.

    `most` bounds the pre-tokens that are broadcast (KNOWN); the result does not depend on it.
    """
    with open(path, encoding="utf-8") as told:
        file = docs.sparkSession.sparkContext.broadcast(told.read())
    dictionary = staged(piece_counts(pre_token_counts(docs, file), file))
    frequent = most_frequent(dictionary, KNOWN if most is None else most).select("pre_token", "pieces").toArrow()
    known = dict(zip(*(frequent.column(c).to_pylist() for c in ("pre_token", "pieces"))))
    sums = staged(_partial_sums(docs, file, docs.sparkSession.sparkContext.broadcast(known)))

    pair = F.explode(F.arrays_zip("rare", "times")).alias("one")
    pairs = sums.filter("row IS NOT NULL").select("row", pair)
    pairs = pairs.select("row", F.col("one.rare").alias("pre_token"), F.col("one.times").alias("n"))
    pieces = dictionary.select("pre_token", "pieces")
    rest = pairs.join(pieces, "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    numbered = sums.filter("row IS NOT NULL").select("doc_id", "n_bytes", "known", "row").join(rest, "row")
    whole = numbered.select("doc_id", "n_bytes", (F.col("known") + F.col("rest")).alias("n_tokens"))
    whole = whole.unionByName(sums.filter("row IS NULL").select("doc_id", "n_bytes", F.col("known").alias("n_tokens")))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
