"""Near duplicates by bottom-k sketches of one hash function.

A text is lower-cased (A-Z) and cut into words `[^\\x20\\x09-\\x0D]+`; its set holds the distinct
shingles of `shingle` words (a text with fewer words is one shingle, one without words has none).
Two texts are linked when 100 * |A and B| >= percent * |A or B|.

1. Equal sets are one class, found by a 128-bit digest; all that follows works on one representative
   of each class, so copies are never paired.
2. The sketch of a set is its `SKETCH` smallest hash values. Inverted lists of the retained values
   give candidates. A pair at the limit shares all but a few of the values of the union's sketch
   (binomially many), so it shares at least `OVERLAP` of `SKETCH` but for one pair in 10^10. A set
   therefore needs that many values that other sets have as well, and enters only the lists of its
   rarest ones: of m shared values the m - OVERLAP + 1 rarest, one of which any partner has too. Where
   a set is so small that any partner's sketch is whole as well, it needs `percent` of its values.
3. Each list has a hub, the set whose values are the most common (an original rather than one of its
   edited copies). Pairs of hub and member that pass an estimate from the sketch of their union are
   verified on their full sets, which links the bulk of every group in one step per member.
4. Two members of a list that are already in one component need no comparison. Where the members
   around a hub are still in several components, all pairs of different components are verified
   on full sets: the members are dealt into blocks of bounded size, each pair of blocks is one
   piece of work, and only one link for each set and block leaves it. No pairs are written out.

Links become components by repeated star steps in tables. Results are per document, by class.

Null and empty texts have no shingles and are linked with nothing. Rows that share doc_id and text
are one class; `component_id` is the smallest doc_id in the component, nulls apart. `kept` is
true where doc_id = component_id, so for each of several rows with that doc_id; where a component
has only null doc_ids, component_id is null and kept is true. A very long text has a sketch as small as any
other's; its shingles are held whole by a task that verifies it. An empty table gives an empty result. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import (
    WordNumbers,
    as_texts,
    grams,
    lowered,
    per_batch,
    rows_named,
    staged,
)
from wardlens.llm.graph import components

SKETCH, OVERLAP = 64, 30
#: Shingles that a block of members may hold, all sets together.
BLOCK_SHINGLES = 400_000
#: Sets that a side of a block may hold; all of one side are compared with all of the other.
BLOCK_SETS = 4_000


def shingle_set(text: bytes, shingle: int, memory: WordNumbers) -> np.ndarray:
    """Sorted distinct hash values of the shingles of a text."""
    words = lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    numbers = memory.of(words)
    return np.unique(grams(numbers, min(shingle, len(words))))


def class_name(values: np.ndarray) -> str | None:
    """A digest of a set; null for the empty one."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest() if len(values) else None


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, class_id (null for empty sets) and sketch of each row."""
    memory = WordNumbers()

    def draw(batch):
        out = {"text_md5": [], "n_shingles": [], "class_id": [], "sketch": []}
        for text in batch.column("text").to_pylist():
            values = shingle_set(text, shingle, memory)
            out["text_md5"].append(hashlib.md5(text, usedforsecurity=False).hexdigest())
            out["n_shingles"].append(len(values))
            out["class_id"].append(class_name(values))
            out["sketch"].append(values[:SKETCH].astype(np.int64))
        return out | {"doc_id": batch.column("doc_id")}

    schema = (
        "doc_id long, text_md5 string, n_shingles long, class_id string, sketch array<long>"
    )
    return per_batch(as_texts(docs), draw, schema)


def class_texts(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class_id and a text of each class in `wanted` (class_id and the doc_id of one of its rows)."""
    memory = WordNumbers()

    def keep(batch):
        names, texts = batch.column("class_id").to_pylist(), batch.column("text").to_pylist()
        same = [class_name(shingle_set(t, shingle, memory)) == n for n, t in zip(names, texts)]
        return {
            "class_id": [n for n, k in zip(names, same) if k],
            "text": [t for t, k in zip(texts, same) if k],
        }

    named = wanted.withColumnRenamed("doc_id", "__id")
    met = as_texts(docs).join(named, F.col("doc_id").eqNullSafe(F.col("__id")))
    found = per_batch(met.select("class_id", "text"), keep, "class_id string, text binary")
    return found.dropDuplicates(["class_id"])


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """value, class_id, n_shingles and weight: the lists that each class has to enter."""
    values = classes.select("class_id", "n_shingles", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = values.join(counts, "value")
    own = Window.partitionBy("class_id")
    ranked = shared.select(
        "value",
        "class_id",
        "n_shingles",
        F.row_number().over(own.orderBy("holders", "value")).alias("rank"),
        F.count("*").over(own).alias("m"),
        F.sum(F.log2("holders")).over(own).alias("weight"),
    )
    size = F.least("n_shingles", F.lit(SKETCH))
    needed = F.greatest(F.floor(size * OVERLAP / SKETCH), F.lit(1))
    whole = F.col("n_shingles") * 100 <= SKETCH * percent  # and so is the sketch of any partner
    exact = F.floor((F.col("n_shingles") * percent + 99) / 100)
    needed = F.when(whole, F.greatest(needed, exact)).otherwise(needed)
    return ranked.filter(F.col("rank") <= F.col("m") - needed + 1).select(
        "value", "class_id", "n_shingles", F.round("weight", 6).alias("weight")
    )


def stars(lists: DataFrame) -> DataFrame:
    """hub, member and their set sizes, each pair once; a hub is not its own member."""
    hubs = lists.groupBy("value").agg(
        F.max(F.struct("weight", "class_id", "n_shingles")).alias("hub"), F.count("*").alias("n")
    )
    hubs = hubs.filter("n > 1").select(
        "value", F.col("hub.class_id").alias("hub"), F.col("hub.n_shingles").alias("hub_size")
    )
    met = lists.join(hubs, "value").filter("class_id <> hub")
    return met.groupBy("hub", F.col("class_id").alias("member")).agg(
        F.first("hub_size").alias("hub_size"), F.first("n_shingles").alias("member_size")
    )


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose union's sketch lets their similarity reach the limit."""
    sketch = classes.select("class_id", "sketch")
    both = pairs.join(sketch.toDF("hub", "hub_sketch"), "hub").join(
        sketch.toDF("member", "member_sketch"), "member"
    )
    # sketches are sorted as unsigned numbers; the order of the union must be the same
    flip = lambda x: x.bitwiseXOR(F.lit(-(2**63)))
    union = F.array_sort(F.transform(F.array_union("hub_sketch", "member_sketch"), flip))
    first = F.slice(union, 1, SKETCH)
    common = F.transform(F.array_intersect("hub_sketch", "member_sketch"), flip)
    hits = F.size(F.array_intersect(first, common))
    return both.filter(hits * SKETCH >= F.size(first) * OVERLAP).select(*pairs.columns)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * |A and B| >= percent * |A or B| of sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _with_size(column: str, other: str, percent: int):
    return F.col(column) * 100 >= F.col(other) * percent


def star_links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links a, b among pairs of hub and member, verified on the full sets."""
    memory = WordNumbers()
    last: dict[bytes, np.ndarray] = {}

    def verify(batch):
        hubs, members = batch.column("hub").to_pylist(), batch.column("member").to_pylist()
        keep = []
        for hub, a, b in zip(
            hubs, batch.column("hub_text").to_pylist(), batch.column("text").to_pylist()
        ):
            if hub not in last:
                last.clear()
                last[hub] = shingle_set(a, shingle, memory)
            keep.append(similar(last[hub], shingle_set(b, shingle, memory), percent))
        return {
            "a": [h for h, k in zip(hubs, keep) if k],
            "b": [m for m, k in zip(members, keep) if k],
        }

    fits = _with_size("hub_size", "member_size", percent)
    fits = fits & _with_size("member_size", "hub_size", percent)
    told = pairs.filter(fits).select("hub", "member")
    told = told.join(texts.toDF("member", "text"), "member")
    told = told.join(texts.toDF("hub", "hub_text"), "hub")
    return per_batch(told, verify, "a string, b string")


def block_links(
    sets: list[np.ndarray], others: list[np.ndarray], apart: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """One link (i, j) at least for each set i and component of `others` that it is linked with.

    `apart[i, j]` says which pairs to verify. Intersections are counted by merging the sorted values
    of each set with all values of `others`.
    """
    found = []
    owner = np.repeat(np.arange(len(others)), [len(s) for s in others])
    values = np.concatenate(others) if others else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for s in others])
    for i, own in enumerate(sets):
        if not apart[i].any():
            continue
        low = np.searchsorted(values, own, "left")
        high = np.searchsorted(values, own, "right")
        spans = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)
        hits = owner[at + np.arange(spans.sum())]
        shared = np.bincount(hits, minlength=len(others))
        union = sizes + len(own) - shared
        linked = apart[i] & (100 * shared >= percent * union) & (sizes > 0)
        found += [(i, int(j)) for j in np.flatnonzero(linked)]
    return found


def rest_links(
    pairs: DataFrame, placed: DataFrame, texts: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """Links between members of one hub that the stars have left in different components.

    `pairs` are all pairs of hub and member, also those that the estimate has dropped; `placed` has
    class_id and component of what is linked so far.
    """
    known = placed.select(F.col("node").alias("member"), "component")
    members = pairs.select("hub", "member", "member_size").join(known, "member", "left")
    members = staged(members.withColumn("component", F.coalesce("component", "member")))
    parts = members.groupBy("hub", "component").agg(
        F.sum("member_size").alias("size"), F.count("*").alias("sets")
    )
    hubs = parts.groupBy("hub").agg(
        F.count("*").alias("parts"),
        F.sum("size").alias("size"),
        F.sum("sets").alias("sets"),
        F.max(F.struct("size", "component", "sets")).alias("main"),
    ).filter("parts > 1")
    # members outside the largest component ask, all members answer; each side in its own blocks
    blocks = lambda size, sets: F.greatest(
        F.ceil(size / (BLOCK_SHINGLES // 2)), F.ceil(sets / BLOCK_SETS)
    ).cast("int")
    hubs = hubs.select(
        "hub",
        F.col("main.component").alias("main"),
        blocks(F.col("size") - F.col("main.size"), F.col("sets") - F.col("main.sets")).alias("askers"),
        blocks(F.col("size"), F.col("sets")).alias("tellers"),
    )
    dealt = members.join(hubs, "hub").join(texts.toDF("member", "text"), "member")

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("member"), F.col(f"{own}ers")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(f"{other}ers") - 1))
        return rows.select(
            "hub", "member", "component", "text", F.lit(name).alias("side"),
            place.alias(own), others.alias(other),
        )

    both = side(dealt.filter("component <> main"), "ask", "ask", "tell").unionByName(
        side(dealt, "tell", "tell", "ask")
    )
    memory = WordNumbers()

    def verify(key, table):
        ask = table.filter(_equal(table, "side", "ask"))
        tell = table.filter(_equal(table, "side", "tell"))
        sets = [shingle_set(t, shingle, memory) for t in ask.column("text").to_pylist()]
        others = [shingle_set(t, shingle, memory) for t in tell.column("text").to_pylist()]
        mine = np.array(ask.column("component").to_pylist(), object)
        theirs = np.array(tell.column("component").to_pylist(), object)
        code = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1].astype(np.int32)
        apart = code[: len(mine), None] != code[None, len(mine) :]
        a, b = ask.column("member").to_pylist(), tell.column("member").to_pylist()
        seen, links = set(), []
        for i, j in block_links(sets, others, apart, percent):
            if (i, theirs[j]) not in seen:
                seen.add((i, theirs[j]))
                links.append((a[i], b[j]))
        return pa.table(
            {"a": [x for x, _ in links], "b": [y for _, y in links]},
            schema=pa.schema([("a", pa.string()), ("b", pa.string())]),
        )

    return both.groupBy("hub", "ask", "tell").applyInArrow(verify, "a string, b string")


def _equal(table, column: str, value: str):
    return pc.equal(table.column(column), value)


def linked_classes(docs: DataFrame, drawn: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node and component of all classes that are linked with another."""
    some = drawn.filter("class_id IS NOT NULL")
    first = staged(some.groupBy("class_id").agg(F.min("doc_id").alias("doc_id")))
    own = first.toDF("__class", "__id")
    met = (F.col("class_id") == F.col("__class")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    classes = some.join(own, met, "left_semi").select("class_id", "n_shingles", "sketch")
    classes = staged(classes.dropDuplicates(["class_id"]))
    pairs = staged(stars(staged(postings(classes, percent))))
    named = pairs.select(F.col("hub").alias("class_id")).union(pairs.select("member")).distinct()
    texts = staged(class_texts(docs, first.join(named, "class_id"), shingle))
    links = staged(star_links(estimated(pairs, classes), texts, shingle, percent))
    more = staged(rest_links(pairs, components(links), texts, shingle, percent))
    return components(links.unionByName(more))


def judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, component_id, kept and group, one row per row of `docs`.

    `group` names the component; it is null for rows that are linked with nothing.
    """
    drawn = staged(sketches(docs, shingle))
    linked = linked_classes(docs, drawn, shingle, percent)
    least = drawn.filter("class_id IS NOT NULL").groupBy("class_id").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n")
    )
    placed = least.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = staged(placed.withColumn("group", F.coalesce("component", "class_id")))
    ends = placed.groupBy("group").agg(
        F.min("least").alias("component_id"), F.sum("n").alias("size")
    )
    answers = placed.join(ends.filter("size > 1"), "group").select(
        "class_id", "group", "component_id"
    )
    found = drawn.drop("sketch").join(answers, "class_id", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        "text_md5",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        "group",
    )


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of `docs`."""
    return judged(docs, shingle, percent).drop("text_md5", "group")


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of near duplicates.

    Rows linked with nothing stay; of a group, the row with the smallest doc_id and, where several
    rows have it, the smallest digest of the text.
    """
    found = staged(judged(docs, shingle, percent))
    grouped = found.filter("group IS NOT NULL")
    stay = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")).alias("x"))
    alone = found.filter("group IS NULL").select("doc_id", "text_md5", F.lit(False).alias("once"))
    stay = stay.select("x.doc_id", "x.text_md5", F.lit(True).alias("once")).unionByName(alone)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows_named(docs, stay.distinct(), F.md5(text.cast("binary")))
