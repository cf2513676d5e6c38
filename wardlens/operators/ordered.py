"""Long sequences: consecutive numbers, neighbours, fill-down and moving means without a one-task sort.

A sequence is cut into ranges of its order, one per task. What crosses a border is small: the number of
rows of each range, the last value of each block, a few rows at its edges. Rows are stored once in the
shared folder, because ranges are chosen by sampling and must not be chosen anew for a second use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlens.sources.sinks import durable, shared_folder

#: Rows of a sequence that one task holds together when rows look at their neighbours.
BLOCK_ROWS = 20_000
#: Bits of monotonically_increasing_id below the number of the task.
_IN_TASK = 33


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def _same(names: Sequence[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for left, right in names:
        on = on & F.col(left).eqNullSafe(F.col(right))
    return on


def numbered(
    df: DataFrame, order: Sequence[str | Column], name: str = "orderId", keys: Sequence[str] = ()
) -> DataFrame:
    """The rows with consecutive numbers from 1 in a given order, within each key or over all rows.

    Rows are dealt by ranges of keys and order, so one key that holds most rows is still spread over all
    tasks; only the number of rows of each key in each range goes through a window. Rows that `order` does
    not tell apart are numbered in any order and stay in one range: give an order that tells them apart.
    Nulls sort as `order` says and are one key. An empty table gives an empty one. A column called `name`
    is replaced.
    """
    df = df.drop(name) if name.lower() in {c.lower() for c in df.columns if c not in keys} else df
    columns = df.columns
    place, task, first, before = (free_name(df, f"_{x}") for x in ("place", "task", "first", "before"))
    sort = [*(F.asc(k) for k in keys), *order]
    ranges = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    stored = durable(ranges.withColumn(place, F.monotonically_increasing_id()), shared_folder(df.sparkSession))
    stored = stored.withColumn(task, F.shiftright(place, _IN_TASK))
    counts = stored.groupBy(task, *keys).agg(F.count("*").alias(before), F.min(place).alias(first))
    earlier = W.partitionBy(*keys).orderBy(task).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    renamed = {c: free_name(df, f"_of_{i}") for i, c in enumerate([task, *keys])}
    found = stored.join(starts.withColumnsRenamed(renamed), _same(list(renamed.items())))
    number = F.col(before) + F.col(place) - F.col(first) + 1
    return found.select(*columns, number.alias(name))


def _blocks(df: DataFrame, order: Sequence[str | Column], rows: int) -> tuple[DataFrame, str, str]:
    """The numbered rows and the names of the columns with their place (from 0) and their block."""
    if rows < 2:
        raise ValueError("a block holds two rows at least")
    place, block = free_name(df, "_lugar"), free_name(df, "_bloque")
    placed = numbered(df, order, place).withColumn(place, F.col(place) - 1)
    return placed.withColumn(block, F.floor(F.col(place) / rows)), place, block


def _with_edges(placed: DataFrame, place: str, block: str, rows: int, back: int, ahead: int) -> DataFrame:
    """Every block with copies of the `back` rows before it and of the `ahead` rows after it.

    Blocks shorter than these reach over several neighbours. A copy has `block` of its host.
    """
    first = F.floor((F.col(place) - ahead) / rows)
    last = F.floor((F.col(place) + back) / rows)
    hosts = F.sequence(F.greatest(first, F.lit(0)), last)
    return placed.withColumn(block, F.explode(hosts))


def neighbours_in_sequence(
    df: DataFrame, order: Sequence[str | Column], col: str, offsets: Sequence[int], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Values of earlier (negative offset) and later rows of the whole table as one sequence.

    They are added as ``<col>_prev<n>`` and ``<col>_next<n>``, null beyond either end. The few rows at the
    edges of each block go to its neighbours as well.
    """
    placed, place, block = _blocks(df, order, block_rows)
    back, ahead = max(0, -min(offsets)), max(0, max(offsets))
    near = _with_edges(placed, place, block, block_rows, back, ahead)
    in_block = W.partitionBy(block).orderBy(place)
    shifted = {
        f"{col}_{'next' if n > 0 else 'prev'}{abs(n)}": F.lag(col, -n).over(in_block) for n in offsets
    }
    own = F.floor(F.col(place) / block_rows) == F.col(block)
    return near.withColumns(shifted).filter(own).select(*df.columns, *shifted)


def fill_down_sequence(
    df: DataFrame, order: Sequence[str | Column], col: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Replace nulls by the last value before them in the whole table as one sequence.

    Each block is filled by itself; the last value of each block is carried into the blocks after it by
    the same rule, over one row per block, again in blocks as long as there are several.
    """
    placed, place, block = _blocks(df, order, block_rows)
    return _filled(placed, place, block, col, block_rows).select(*df.columns)


def _filled(placed: DataFrame, place: str, block: str, col: str, rows: int) -> DataFrame:
    before = W.partitionBy(block).orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.withColumn(col, F.last(col, ignorenulls=True).over(before))
    ends = placed.groupBy(block).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col(place))).alias(col))
    ends = durable(ends.select(F.col(block).alias(place), F.col(col)), shared_folder(placed.sparkSession))
    if ends.agg(F.coalesce(F.max(place), F.lit(0))).first()[0] == 0:
        return inside
    ends = _filled(ends.withColumn(block, F.floor(F.col(place) / rows)), place, block, col, rows)
    host, carried = free_name(placed, "_de"), free_name(placed, "_valor")
    carry = ends.select((F.col(place) + 1).alias(host), F.col(col).alias(carried))
    joined = inside.join(carry, F.col(block) == F.col(host), "left")
    return joined.withColumn(col, F.coalesce(col, carried)).drop(host, carried)


def moving_average_sequence(
    df: DataFrame,
    order: Sequence[str | Column],
    value: str,
    n: int,
    name: str = "media_movil",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean over the last ``n`` rows of the whole table as one sequence; null before the n-th row.

    As in :func:`moving_average`, a window with a missing value gives null.
    """
    placed, place, block = _blocks(df, order, block_rows)
    near = _with_edges(placed, place, block, block_rows, n - 1, 0)
    last_n = W.partitionBy(block).orderBy(place).rowsBetween(-(n - 1), W.currentRow)
    full = F.count(value).over(last_n) == n
    own = F.floor(F.col(place) / block_rows) == F.col(block)
    found = near.withColumn(name, F.when(full, F.avg(value).over(last_n)))
    return found.filter(own).select(*[c for c in df.columns if c != name], name)
