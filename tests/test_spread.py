"""Records that are multiplied within a stage stay in all shuffle partitions."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardlens.catalog.queries import QUERIES
from wardlens.operators import keys

BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
MERGE = "spark.sql.adaptive.coalescePartitions.enabled"
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def settings(spark, **values):
    names = {"broadcast": BROADCAST, "merge": MERGE, "first": FIRST}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_spread_keeps_null_and_repeated_keys(spark):
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (2, None)]
    got = keys.spread(spark.createDataFrame(rows, "GlobalRecordId long, v string")).collect()
    assert Counter(map(tuple, got)) == Counter(rows)


@pytest.mark.parametrize(
    ("values", "parts"), [({}, 4), ({"first": "7"}, 7), ({"first": "7", "merge": "false"}, 4)]
)
def test_a_spread_table_is_joined_without_another_shuffle(spark, values, parts):
    with settings(spark, broadcast="-1", **values):
        left = keys.spread(spark.range(400).withColumnRenamed("id", "GlobalRecordId"))
        right = spark.range(400).selectExpr("id % 200 AS GlobalRecordId", "id AS v")
        slots = right.groupBy("GlobalRecordId").agg(F.max("v").alias("v"))
        joined = left.join(slots, "GlobalRecordId", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and plan.count(f", {parts})") == 2
        assert tasks(joined) == parts
        assert joined.count() == 400 and joined.filter("v = GlobalRecordId + 200").count() == 200


@pytest.fixture
def form(spark, tmp_path):
    """120 orders with two lines, the second one on slot 3; one without lines, one given twice."""
    day = datetime(1997, 1, 2)
    numbers = [n for n in range(1, 131) if n % 13]
    orders = [(n, "O", day) for n in [*numbers, numbers[0], 1001]]
    lines = [(n, n, 3 + k, k, 5.0, "F", day) for n in numbers for k in (1, 3)]
    frames = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame(
            lines,
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
            " l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), numbers


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_long_to_rows_sorts_in_all_partitions(spark, form, broadcast):
    folder, numbers = form
    with settings(spark, broadcast=broadcast):
        rows = QUERIES["q38_long_to_rows"](spark, folder)
        assert tasks(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = rows.collect()
    assert sorted((r.GlobalRecordId, r.slot) for r in got) == [(n, k) for n in numbers for k in (1, 3)]
    first = next(r for r in got if (r.GlobalRecordId, r.slot) == (1, 1))
    assert tuple(first)[2:] == ("INACTIVO", "Clostridium difficile", "1997-01-02", "AmpC", None)
