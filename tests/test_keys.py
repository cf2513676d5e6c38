"""First rows, membership, append, merge, upsert."""

from datetime import date

from pyspark.sql import functions as F

from wardlens.operators import columns as c
from wardlens.operators import keys as k


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def test_first_per_key_keeps_the_whole_first_row(spark):
    df = spark.createDataFrame(
        [("a", 2, "late"), ("a", 1, "early"), (None, 1, "x"), (None, 2, "y")],
        "k string, n int, v string",
    )
    assert tuples(k.first_per_key(df, ["k"], ["n"])) == [("a", 1, "early"), (None, 1, "x")]


def test_first_per_key_cuts_each_key_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = k.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_membership_with_and_without_null_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "GlobalRecordId string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "GlobalRecordId string")
    assert tuples(k.keep_known(left, right)) == [("a",)]
    assert tuples(k.drop_known(left, right)) == [("b",), (None,)]
    assert tuples(k.keep_known(left, right, null_safe=True)) == [("a",), (None,)]
    assert tuples(k.drop_known(left, right, null_safe=True)) == [("b",)]


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert tuples(k.append(a, b)) == [(1, "x"), (2, None)]


def test_bind_by_key_matches_null_and_leaves_gaps(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 30)], "k string, n int")
    assert tuples(k.bind_by_key(left, right, "k")) == [
        ("a", 1, 10),
        ("b", 2, None),
        (None, 3, 30),
    ]


def test_number_rows(spark):
    df = spark.createDataFrame([("b", 20), ("a", 10)], "v string, position int")
    assert tuples(k.number_rows(df, ["position"]), "v", "orderId") == [("a", 1), ("b", 2)]


def snapshots(spark):
    schema = "GlobalRecordId string, RECSTATUS int, extra string"
    newest = spark.createDataFrame([("all", 1, "new"), ("deleted", 0, "new")], schema)
    middle = spark.createDataFrame([("all", 1, "mid"), ("deleted", 1, "mid"), ("m", 1, "mid")], schema)
    oldest = spark.createDataFrame(
        [("all", 1), ("deleted", 1), ("o", 1)], "GlobalRecordId string, RECSTATUS int"
    )
    return [newest, middle, oldest]


def test_snapshot_merge_lets_the_newest_decide_even_on_deletion(spark):
    merged = k.snapshot_merge(snapshots(spark))
    assert tuples(merged) == [("all", 1, "new"), ("m", 1, "mid"), ("o", 1, None)]


def test_snapshot_merge_ignores_repeated_snapshots(spark):
    new, mid, old = snapshots(spark)
    assert tuples(k.snapshot_merge([new, new, mid, mid, old])) == tuples(
        k.snapshot_merge([new, mid, old])
    )


def test_upsert_replaces_the_day_and_drops_undated_rows(spark):
    history = spark.createDataFrame(
        [("2022-01-01 10:00:00", 1), ("2022-01-02 00:00:00", 2), (None, 3)], "fecha string, n int"
    ).withColumn("fecha", F.to_timestamp("fecha"))
    today = spark.createDataFrame([(9, "x")], "n int, extra string").withColumn(
        "fecha", F.lit("2022-01-01").cast("timestamp")
    )
    day = date(2022, 1, 1)
    once = k.upsert_by_date(history, today, day)
    assert [(r.n, r.extra) for r in once.collect()] == [(9, "x"), (2, None)]
    assert tuples(k.upsert_by_date(once, today, day)) == tuples(once)


def test_column_selectors(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "fechaIngreso1 int, cama1 int, camaActual int, LastSaveTime int")
    assert c.starting_with(df, "FECHA", "cama") == ["fechaIngreso1", "cama1", "camaActual"]
    assert c.containing(df, "time") == ["LastSaveTime"]
    assert c.matching(df, r"cama\d") == ["cama1"]
    assert c.ending_with(df, "1") == ["fechaIngreso1", "cama1"]
    assert c.relocate(df, "LastSaveTime").columns[0] == "LastSaveTime"
    assert c.relocate(df, "LastSaveTime", after="cama1").columns[2] == "LastSaveTime"
    assert c.across(df, ["cama1", "camaActual"], lambda x: x * 10).first()[1:3] == (20, 30)
    assert c.derive(df, {"a": F.col("cama1") + 1, "b": F.col("a") * 2}).first().b == 6
    shown = c.present(df, {"cama1": "Cama"}, F.asc_nulls_last("cama1"))
    assert shown.columns == ["Cama"]
