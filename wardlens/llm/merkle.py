"""Merkle manifest of a corpus: a tree of digests over the documents of each language, blocks laid out for locality.

A leaf is the digest of a row. Leaves of one language ascend by doc_id; every eight consecutive nodes
become their digest until one is left, and the languages' roots do likewise up to the root. The tree is
kept in aligned blocks of `HEIGHT` steps (512 leaves). A block's digests stand in one array in van Emde Boas
order: the upper half of its levels first, then every subtree of the lower half, each laid out in the same
way, so a path from leaf to root touches few stretches of memory whatever the size of a cache line. A node's
address follows from its level and index alone (`address`). The roots of blocks are the leaves of blocks above, by the
same rule, until a language has one block: 10^11 documents take five levels of blocks. Then paths go down,
block by block, and each document gets its proof from its own block's array and its block's path.

No task holds more than blocks of 512 rows; a language with most rows is many blocks. Defined results: null
fields count as `-`; an empty text is `0:`; rows with a null doc_id come first and are never tampered with;
rows with equal doc_id ascend by leaf, and equal leaves are interchangeable. Very long texts cost one digest each.
An empty table gives an empty result. Columns besides doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import per_batch, staged
from wardlens.operators.ordered import numbered

#: Nodes that become one, and steps from a block's leaves to its root.
FAN, HEIGHT = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def combined(parts: list[str]) -> str:
    """The digest of hex digests, as hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the nodes `index` at `depth` (the root's is 0)."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower = levels - upper
    below = FAN ** (depth - upper)
    return tree_size(upper) + index // below * tree_size(lower) + address(lower, depth - upper, index % below)


@cache
def addresses(levels: int) -> list[np.ndarray]:
    """The places of all nodes, depth by depth."""
    return [address(levels, d, np.arange(FAN**d)) for d in range(levels)]


def height_of(n: int) -> int:
    """Steps after which n nodes are one."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def laid_out(leaves: list[str]) -> bytes:
    """The nodes over the leaves of a block, in van Emde Boas order, 32 bytes each; missing ones are zero."""
    height = height_of(len(leaves))
    places, nodes, row = addresses(height + 1), {}, leaves
    for depth in range(height, -1, -1):
        nodes.update(zip(places[depth].tolist(), row))
        row = [combined(row[i : i + FAN]) for i in range(0, len(row), FAN)]
    return b"".join(bytes.fromhex(nodes[k]) if k in nodes else bytes(32) for k in range(max(nodes) + 1))


class Block:
    """Reads nodes, siblings and roots out of an array of `laid_out`."""

    def __init__(self, nodes: bytes, n: int):
        self.hex, self.n, self.height = nodes.hex(), n, height_of(n)
        self.places = [p.tolist() for p in addresses(self.height + 1)]
        counts = [n]
        while len(counts) <= self.height:
            counts.append(-(-counts[-1] // FAN))
        self.counts = counts[::-1]  # by depth

    def node(self, depth: int, index: int) -> str:
        at = 64 * self.places[depth][index]
        return self.hex[at : at + 64]

    def leaves(self) -> list[str]:
        return [self.node(self.height, i) for i in range(self.n)]

    def whole_root(self, height: int) -> str:
        """The root after `height` steps: a lone node is a run of one at each step that is left."""
        return reduce(lambda root, _: combined([root]), range(height - self.height), self.node(0, 0))

    def siblings(self) -> list[tuple[list[str], list[str]]]:
        """For each leaf what stands left and right of it and of each node above it, step by step."""
        steps = []
        for depth in range(self.height, 0, -1):
            row = [self.node(depth, i) for i in range(self.counts[depth])]
            runs = [row[i : i + FAN] for i in range(0, len(row), FAN)]
            steps.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        found = []
        for i in range(self.n):
            path = [step[i // FAN**k] for k, step in enumerate(steps)]
            found.append(([a for a, _ in path], [b for _, b in path]))
        return found


def folded(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf leads to with these siblings."""
    for left, right in zip(lefts, rights):
        leaf = combined([left, leaf, right])
    return leaf


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    """The digest of a row with `text` as its text; a column that is missing counts as null."""
    fields = [F.col(c) if c in docs.columns else F.lit(None) for c in ("doc_id", "source", "lang", "n_chars")]
    values = [c.cast("string") for c in (*fields, text)]
    told = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values
    ]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and tampered: the leaf with the text in lower case where 3 divides the id's crc32."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_digest(docs, text).alias("leaf"),
        F.when(chosen, leaf_digest(docs, F.translate(text, UPPER, LOWER))).alias("tampered"),
    )


def blocks_of(leaves: DataFrame, height: int, *payload: str) -> DataFrame:
    """Blocks (sequence, block, n, nodes, root, apex) of rows (sequence, place from 0, leaf), stored.

    `root` is the block's root after `height` steps, `apex` the first single node; the columns of `payload`
    come along as lists in the order of the leaves.
    """
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    block = F.floor(F.col("place") / FAN**height).alias("block")
    lists = [F.col(f"listed.{c}").alias(c) for c in ("leaf", *payload)]
    listed = F.array_sort(F.collect_list(F.struct("place", "leaf", *payload))).alias("listed")
    grouped = leaves.groupBy("sequence", block).agg(listed).select("sequence", "block", *lists)

    def build(batch: pa.RecordBatch) -> dict:
        out = {"n": [], "nodes": [], "root": [], "apex": []}
        for leaf in batch.column("leaf").to_pylist():
            nodes = laid_out(leaf)
            made = Block(nodes, len(leaf))
            for name, value in zip(out, (len(leaf), nodes, made.whole_root(height), made.node(0, 0))):
                out[name].append(value)
        return out | {c: batch.column(c) for c in ("sequence", "block", *payload)}

    schema = "sequence string, block long, n int, nodes binary, root string, apex string"
    return staged(per_batch(grouped, build, schema + "".join(f", {c} array<{kinds[c]}>" for c in payload)))


def levels_of(blocks: DataFrame, height: int) -> list[DataFrame]:
    """Blocks over the roots of blocks, level by level, until every sequence has one block.

    A sequence with one block has no block above it.
    """
    levels = [blocks]
    while True:
        several = levels[-1].groupBy("sequence").agg(F.max("block").alias("last")).filter("last > 0")
        several = several.select(F.col("sequence").alias("several"))
        roots = levels[-1].select("sequence", F.col("block").alias("place"), F.col("root").alias("leaf"))
        above = roots.join(several, F.col("sequence").eqNullSafe(F.col("several")), "left_semi")
        above = blocks_of(above, height)
        if above.isEmpty():
            return levels
        levels.append(above)


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """sequence and the root of its tree."""
    tops = []
    for below, above in zip(levels, [*levels[1:], None]):
        only = below.filter("block = 0").select("sequence", F.col("apex").alias("top"))
        if above is not None:
            upper = above.select(F.col("sequence").alias("upper")).distinct()
            only = only.join(upper, F.col("sequence").eqNullSafe(F.col("upper")), "left_anti")
        tops.append(only)
    return reduce(DataFrame.unionByName, tops)


_PATH = "lefts array<string>, rights array<string>"


def paths_of(blocks: DataFrame, height: int) -> DataFrame:
    """The path to the root of each leaf of `blocks` (with the paths of their own), by sequence and block."""

    def descend(batch: pa.RecordBatch) -> dict:
        out = {"sequence": [], "block": [], "lefts": [], "rights": []}
        rows = batch.to_pylist()
        for row in rows:
            for i, (lefts, rights) in enumerate(Block(row["nodes"], row["n"]).siblings()):
                out["sequence"].append(row["sequence"])
                out["block"].append(row["block"] * FAN**height + i)
                out["lefts"].append(lefts + row["lefts"])
                out["rights"].append(rights + row["rights"])
        return out

    columns = blocks.select("sequence", "block", "n", "nodes", "lefts", "rights")
    return per_batch(columns, descend, f"sequence string, block long, {_PATH}")


def _joined(blocks: DataFrame, paths: DataFrame, *on: str) -> DataFrame:
    renamed = paths.withColumnsRenamed({c: f"of_{c}" for c in on})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in on))
    return blocks.join(renamed, same).drop(*(f"of_{c}" for c in on))


def with_paths(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest blocks with their roots' paths; `tops` has the path of each sequence's root."""
    found, runs = None, F.col("n")
    short = sum((F.when(runs <= FAN**h, 1).otherwise(0) for h in range(height)), F.lit(0))
    lone = F.array_repeat(F.lit(""), short)
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k]
        if k == len(levels) - 1:
            found = _joined(blocks, tops, "sequence")
            continue
        below = _joined(blocks, paths_of(found, height), "sequence", "block")
        steps = [F.concat(lone, F.col(c)).alias(c) for c in ("lefts", "rights")]  # runs of one up to the block's root
        below = below.select(*blocks.columns, *steps)
        upper = levels[k + 1].select(F.col("sequence").alias("upper")).distinct()
        only = blocks.join(upper, F.col("sequence").eqNullSafe(F.col("upper")), "left_anti")
        found = below.unionByName(_joined(only, tops, "sequence"))
    return found


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row of `docs`.

    Blocks have `height` steps; the result does not depend on it.
    """
    leaves = staged(leaf_rows(docs))
    placed = numbered(leaves, ["doc_id", "leaf"], "place", ["lang"])
    placed = placed.select(
        F.col("lang").alias("sequence"), (F.col("place") - 1).alias("place"), "leaf", "doc_id", "tampered"
    )
    levels = levels_of(blocks_of(placed, height, "doc_id", "tampered"), height)
    subroots = staged(tops_of(levels))

    ordered = numbered(subroots, [F.asc_nulls_first("sequence")], "place")
    ordered = ordered.select(
        F.lit("").alias("sequence"), (F.col("place") - 1).alias("place"), F.col("top").alias("leaf"),
        F.struct(F.col("sequence").alias("lang")).alias("of"),
    )
    upper = levels_of(blocks_of(ordered, height, "of"), height)
    no_path = [F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")]
    root = tops_of(upper)
    paths = paths_of(with_paths(upper, root.select("sequence", *no_path), height), height)
    paths = _joined(paths, root.select("sequence", F.col("top").alias("whole_root")), "sequence")
    named = ordered.select(
        F.col("place").alias("block"), F.col("of.lang").alias("sequence"), F.col("leaf").alias("subroot")
    )
    tops = staged(paths.drop("sequence").join(named, "block").drop("block"))
    found = with_paths(levels, tops.select("sequence", "lefts", "rights"), height)
    return _proofs(_joined(found, tops.select("sequence", "subroot", "whole_root"), "sequence"))


def _proofs(blocks: DataFrame) -> DataFrame:
    def prove(batch: pa.RecordBatch) -> dict:
        names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        out = {c: [] for c in names}
        for row in batch.to_pylist():
            block = Block(row["nodes"], row["n"])
            upper = "".join(a + b for a, b in zip(row["lefts"], row["rights"]))
            told = zip(row["doc_id"], block.leaves(), row["tampered"], block.siblings())
            for doc_id, leaf, tampered, (lefts, rights) in told:
                inner = "".join(a + b for a, b in zip(lefts, rights))
                end = folded(tampered or leaf, lefts + row["lefts"], rights + row["rights"])
                proof = combined([inner, upper])
                values = (doc_id, leaf, row["subroot"], row["whole_root"], proof, end, end == row["whole_root"])
                for name, value in zip(names, values):
                    out[name].append(value)
        return out

    schema = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
        " verified boolean"
    )
    return per_batch(blocks, prove, schema)
