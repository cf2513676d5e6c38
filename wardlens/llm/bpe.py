"""Byte-level BPE: encoding by a queue of merge ranks over a linked list, decoding by the vocabulary.

The vocabulary file is the parameter `path` (tokenizers' JSON). It is read on the driver and sent
to the tasks as one broadcast; its size, a few MB, does not depend on the input. A text is split
at the special tokens, then by the pattern of byte-level BPE; each piece's bytes become symbols of a
doubly linked list. A heap holds (rank, place) of the pairs that can merge; an entry whose pair has
changed since is stale and skipped. The pieces met before are kept per process, up to a bound.

A null text is empty: no tokens. Rows are encoded one by one, so repeated rows and null doc_ids
keep their own rows; columns besides doc_id and text are not read. An empty table gives an empty result. A very
long text is encoded by one task, piece by piece; a very long piece takes n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from wardlens.llm.common import as_texts, per_batch

# Fixed value: the split of byte-level BPE
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered in each of two halves, in a process, and the longest piece that is.
REMEMBERED, LONGEST = 180_000, 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Vocabulary:
    """Ids, ranks of merges and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        letters = {c: b for b, c in byte_letters().items()}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.byte_ids = [ids[c] for _, c in sorted(byte_letters().items())]
        # both ids of a pair in one number, and rank and made id in one: they order by rank
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << 32 | ids[right]] = rank << 32 | ids[left + right]
        self.bytes = {
            str(i): bytes(letters[c] for c in word)
            for word, i in ids.items()
            if word not in self.special
        }
        self.bytes |= {str(i): word.encode() for word, i in self.special.items()}


class Pieces(dict):
    """The ids of pieces joined by commas, those met lately from memory.

    Full memory becomes the older half; what is met again comes back from there.
    """

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, piece: str) -> str:
        found = self.older.get(piece)
        if found is None:
            found = ",".join(map(str, self.merge(piece.encode())))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encodes and decodes with one vocabulary; made once in each process."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges, self.byte_ids = vocabulary.merges, vocabulary.byte_ids
        self.bytes, self.special = vocabulary.bytes, vocabulary.special
        self.pieces = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known = Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. An entry of the queue is rank, made id and place in one number."""
        find = self.merges.get
        ids = list(map(self.byte_ids.__getitem__, piece))
        n = len(ids)
        queue = [
            found << 32 | i
            for i, (left, right) in enumerate(zip(ids, ids[1:]))
            if (found := find(left << 32 | right))
        ]
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n:
                continue
            best = entry >> 32
            if find(left << 32 | ids[j]) != best:
                continue  # stale: a neighbour has merged since
            ids[i] = made = best & 0xFFFFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := find(made << 32 | ids[k]):
                    push(queue, found << 32 | i)
            h = before[i]
            if h >= 0 and (found := find(ids[h] << 32 | made)):
                push(queue, found << 32 | h)
        return [x for x in ids if x >= 0]

    def _stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for match in self.specials.finditer(text) if self.specials else ():
            yield text[at : match.start()], False
            yield match[0], True
            at = match.end()
        yield text[at:], False

    def encode_joined(self, text: str) -> tuple[str, int]:
        """All ids joined by commas, and their number."""
        parts: list[str] = []
        for stretch, special in self._stretches(text):
            if special:
                parts.append(str(self.special[stretch]))
            else:
                parts += map(self.known.__getitem__, self.pieces(stretch))
        joined = ",".join(parts)
        return joined, joined.count(",") + 1 if joined else 0

    def encode(self, text: str) -> list[int]:
        joined, total = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if total else []

    def decode_joined(self, joined: str) -> str:
        """Vocabulary strings of ids joined by commas, joined; bytes that are no UTF-8 are replaced."""
        if not joined:
            return ""
        return b"".join(map(self.bytes.__getitem__, joined.split(","))).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


def _codec(shared) -> Codec:
    codec = _CODECS.get(shared.value["key"])
    if codec is None:
        _CODECS.clear()
        codec = _CODECS[shared.value["key"]] = Codec(shared.value["vocabulary"])
    return codec


_CODECS: dict[str, Codec] = {}


def _broadcast(docs: DataFrame, path: str):
    vocabulary = {"key": path, "vocabulary": Vocabulary(path)}
    return docs.sparkSession.sparkContext.broadcast(vocabulary)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, and whether decoding gives the text again, of each row."""
    shared = _broadcast(docs, path)

    def encode(batch):
        codec = _codec(shared)
        out = {"n_tokens": [], "ids": [], "round_trip": []}
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            joined, total = codec.encode_joined(text)
            out["n_tokens"].append(total)
            out["ids"].append(np.fromstring(joined, np.int32, sep=","))
            out["round_trip"].append(codec.decode_joined(joined) == text)
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
    return per_batch(as_texts(docs), encode, schema)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    shared = _broadcast(docs, path)

    def encode(batch):
        codec = _codec(shared)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for raw in batch.column("text").to_pylist():
            joined, total = codec.encode_joined(raw.decode("utf-8", "replace"))
            out["n_tokens"].append(total)
            out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            decoded = codec.decode_joined(joined).encode()
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_batch(as_texts(docs), encode, schema)
