"""A bounded set of 64-bit hashes that tasks can ask: may say yes by chance, never no to what is in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardlens.llm.common import mixed

#: Bits for each member, and the least and most bits of a bitmap; bytes of it that travel together.
BITS_EACH, LEAST_BITS, MOST_BITS, PART_BYTES = 16, 1 << 16, 1 << 27, 1 << 13


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return mixed(hashes) & np.uint64(bits - 1)


class Bitmap:
    """One bit for each hash, at most MOST_BITS whatever the number of members."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8)
        for part, told in parts.items():
            self.bytes[part * PART_BYTES : (part + 1) * PART_BYTES] = np.frombuffer(told, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = slots(hashes, self.bits)
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], members: int | None = None) -> Bitmap:
    """The bitmap of the hashes of all rows; made in tasks, joined by parts, at most MOST_BITS on the driver."""
    bits, wanted = LEAST_BITS, (rows.count() if members is None else members) * BITS_EACH
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits, bool)
        for batch in batches:
            marks[slots(hashes(batch), bits).astype(np.int64)] = True
        table = np.packbits(marks, bitorder="little").reshape(-1, PART_BYTES)
        some = np.flatnonzero(table.any(axis=1))
        parts = [pa.array(some, pa.int32()), pa.array([table[k].tobytes() for k in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(parts, names=["part", "bytes"])

    def joined(table: pa.Table) -> pa.Table:
        told = reduce(np.bitwise_or, (np.frombuffer(b, np.uint8) for b in table.column("bytes").to_pylist()))
        return pa.table({"part": table.column("part")[:1], "bytes": pa.array([told.tobytes()], pa.binary())})

    marked = rows.mapInArrow(mark, "part int, bytes binary")
    whole = marked.groupBy("part").applyInArrow(joined, "part int, bytes binary").collect()
    return Bitmap(bits, {row["part"]: bytes(row["bytes"]) for row in whole})
