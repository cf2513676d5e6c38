"""Long sequences against plain lists: block and partition edges, empty ranges, ties, nulls, hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from wardlens.operators import ordered


def rows_of(n, seed=1):
    pick = random.Random(seed)
    return [(pick.choice(["a", "a", "a", "b", None]), None if pick.random() < 0.1 else pick.randrange(n // 2 + 1), k,
             float(k) if pick.random() < 0.3 else None) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "grupo string, valor int, id long, dato double")


def sort_key(row):
    return (row[1] is None, row[1] or 0, row[2])


def order():
    return [F.asc_nulls_last("valor"), "id"]


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_numbers_within_keys_and_over_all(spark, n):
    rows = rows_of(n)
    df = table(spark, rows).repartition(5)
    found = {r.id: r.orderId for r in ordered.numbered(df, order()).collect()}
    assert found == {r[2]: k for k, r in enumerate(sorted(rows, key=sort_key), 1)}
    within = {r.id: r.pos for r in ordered.numbered(df, order(), "pos", ["grupo"]).collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=sort_key)
        expected |= {r[2]: k for k, r in enumerate(own, 1)}
    assert within == expected


def test_a_key_with_nearly_all_rows_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("x").alias("grupo"), "id")
    plan = ordered.numbered(df, ["id"], "pos", ["grupo"])
    assert plan.filter("pos <> id + 1").isEmpty()
    sizes = df.repartitionByRange(4, "grupo", "id").groupBy(F.spark_partition_id()).count()
    assert sizes.count() > 1


def test_equal_rows_get_different_numbers(spark):
    df = spark.createDataFrame([(1, None)] * 30 + [(0, "x")] * 20, "valor int, grupo string")
    rows = ordered.numbered(df, ["valor"], "VALOR2", ["grupo"]).collect()
    assert sorted(r.VALOR2 for r in rows if r.valor == 1) == list(range(1, 31))
    assert sorted(r.VALOR2 for r in rows if r.valor == 0) == list(range(1, 21))


def test_names_that_clash(spark):
    names = ["_place", "_TASK", "_first", "_before", "_of_0", "_lugar", "_Bloque", "_de", "_valor", "id"]
    df = spark.createDataFrame([tuple(range(k, k + len(names))) for k in range(40)], ", ".join(f"`{n}` int" for n in names))
    assert ordered.numbered(df, ["id"], "orderId").columns == [*names, "orderId"]
    filled = ordered.fill_down_sequence(df, ["id"], "_valor", 7)
    assert sorted(map(tuple, filled.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n, block", [(0, 5), (3, 5), (100, 6), (500, 1000)])
def test_neighbours_fill_and_averages_across_blocks(spark, n, block):
    rows = rows_of(n, seed=n)
    df = table(spark, rows).repartition(4)
    line = sorted(rows, key=sort_key)
    near = ordered.neighbours_in_sequence(df, order(), "grupo", [-3, -1, 2], block).collect()
    at = lambda k: line[k][0] if 0 <= k < n else None
    assert {r.id: (r.grupo_prev3, r.grupo_prev1, r.grupo_next2) for r in near} == {
        r[2]: (at(k - 3), at(k - 1), at(k + 2)) for k, r in enumerate(line)}
    assert len(near) == n

    filled = {r.id: r.dato for r in ordered.fill_down_sequence(df, order(), "dato", block).collect()}
    last, expected = None, {}
    for r in line:
        last = r[3] if r[3] is not None else last
        expected[r[2]] = last
    assert filled == expected

    means = {r.id: r.media_movil for r in ordered.moving_average_sequence(df, order(), "id", 4, block_rows=block).collect()}
    ids = [r[2] for r in line]
    assert means == {i: sum(ids[k - 3 : k + 1]) / 4 if k >= 3 else None for k, i in enumerate(ids)}


def test_a_long_stretch_without_values_is_carried_over_many_blocks(spark):
    df = spark.range(300).select("id", F.when(F.col("id").isin(2, 250), F.col("id")).alias("dato"))
    found = {r.id: r.dato for r in ordered.fill_down_sequence(df, ["id"], "dato", 12).collect()}
    assert found == {i: None if i < 2 else 2 if i < 250 else 250 for i in range(300)}
