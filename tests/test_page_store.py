"""Pages stored by key: joins without a shuffle, purges that touch few files, stops between pages."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wardlens.operators.keys import snapshot_merge
from wardlens.operators.reshape import cross_table_found, found_classes
from wardlens.sources import ChangedMeanwhile, join_pages, page_store, safe_replace, table_version

KEY = "GlobalRecordId"
NAMES = ["a", "b", "c"]


def form(spark, n=200):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias(KEY), "id")
    return {
        "a": keys.withColumn("x", F.col("id") * 2).drop("id"),
        "b": keys.filter("id % 2 = 0").withColumn("y", F.col("id") + 1).drop("id"),
        "c": keys.select(KEY, F.lit(None).cast("string").alias("z")).union(spark.sql("SELECT NULL, 'sin clave'")),
    }


def keys_of(pages):
    return {name: sorted(str(r[0]) for r in page.select(KEY).collect()) for name, page in pages.items()}


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "_pendiente" not in d}


def doomed_of(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], f"{KEY} string")


def test_stored_pages_are_those_written(spark, tmp_path):
    page_store.write_pages(form(spark), str(tmp_path), 8)
    stored = page_store.read_pages(spark, str(tmp_path), NAMES)
    for name, page in form(spark).items():
        assert stored[name].columns == page.columns
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, page.collect()))


def test_a_purge_rewrites_only_buckets_with_purged_keys(spark, tmp_path):
    folder = str(tmp_path)
    page_store.write_pages(form(spark), folder, 16)
    before, keys = files_of(folder), keys_of(page_store.read_pages(spark, folder, NAMES))
    for _ in range(2):  # the second changes nothing
        page_store.purge_pages(spark, folder, NAMES, doomed_of(spark, "k4", "k7", "nobody", None), 16)
        after = keys_of(page_store.read_pages(spark, folder, NAMES))
        assert after == {n: [k for k in ks if k not in ("k4", "k7")] for n, ks in keys.items()}
    same = {p for p, t in files_of(folder).items() if before.get(p) == t}
    gone = {os.path.relpath(p, folder).split(os.sep)[0] for p in before.keys() - same}
    assert gone == set(NAMES)
    assert len(before.keys() - same) <= 2 + 1 + 2  # buckets of two keys, one in page b


def test_a_bucket_that_loses_all_rows(spark, tmp_path):
    folder = str(tmp_path)
    pages = {"a": doomed_of(spark, "k1", "k2", "k3")}
    page_store.write_pages(pages, folder, 64)
    page_store.purge_pages(spark, folder, ["a"], doomed_of(spark, "k2"), 64)
    assert keys_of(page_store.read_pages(spark, folder, ["a"])) == {"a": ["k1", "k3"]}


def test_pages_agree_after_a_stop_between_two_of_them(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    page_store.write_pages(form(spark), folder, 8)
    whole = page_store._purge_page

    def stops(spark, folder, name, *rest):
        if name == "b":
            raise KeyboardInterrupt
        whole(spark, folder, name, *rest)

    monkeypatch.setattr(page_store, "_purge_page", stops)
    with pytest.raises(KeyboardInterrupt):
        page_store.purge_pages(spark, folder, NAMES, doomed_of(spark, "k10", "k11"), 8)
    told = keys_of(page_store.read_pages(spark, folder, NAMES))
    assert not any(k in ("k10", "k11") for ks in told.values() for k in ks)
    assert len(told["a"]) == 198 and len(told["b"]) == 99 and len(told["c"]) == 199
    monkeypatch.setattr(page_store, "_purge_page", whole)
    page_store.purge_pages(spark, folder, NAMES, doomed_of(spark, "k12"), 8)  # finishes the first as well
    stored = {n: spark.read.parquet(f"{folder}/{n}") for n in NAMES}
    assert {n: len(ks) for n, ks in keys_of(stored).items()} == {"a": 197, "b": 98, "c": 198}
    assert not os.path.exists(f"{folder}/_pendiente")


def test_bucketed_pages_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = page_store.write_bucketed(form(spark), str(tmp_path), "prueba_", 4)
        wide = join_pages(pages)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert sorted(map(str, wide.collect())) == sorted(map(str, join_pages(form(spark)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in NAMES:
            spark.sql(f"DROP TABLE IF EXISTS prueba_{name}")


def test_of_two_runs_that_read_the_same_table_one_fails(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS dos")
    try:
        table = "dos.historico"
        assert table_version(spark, table) is None
        safe_replace(spark.createDataFrame([("2022-01-01", 1)], "fecha string, n int"), table, version=None)
        first, second = table_version(spark, table), table_version(spark, table)
        rows = [spark.table(table).selectExpr("fecha", f"n + {k} AS n") for k in (10, 20)]
        safe_replace(rows[0], table, version=first)
        with pytest.raises(ChangedMeanwhile):
            safe_replace(spark.createDataFrame([("2022-01-01", 99)], "fecha string, n int"), table, version=second)
        assert [r.n for r in spark.table(table).collect()] == [11]
        assert [t.name for t in spark.catalog.listTables("dos")] == ["historico"]
        safe_replace(spark.table(table).selectExpr("fecha", "n + 1 AS n"), table)  # without a version as before
        assert [r.n for r in spark.table(table).collect()] == [12]
    finally:
        spark.sql("DROP DATABASE dos CASCADE")


def test_classes_found_in_the_data(spark):
    rows = [("u", "b"), ("u", "b"), ("u", "A'q`"), ("v", None), (None, "ñ"), ("v", "á")]
    df = spark.createDataFrame(rows, "planta string, clase string")
    assert found_classes(df, "clase") == ["A'q`", "b", "á", "ñ"]
    wide = cross_table_found(df, "planta", "clase")
    assert wide.columns == ["planta", "A'q`", "b", "á", "ñ"]
    assert {tuple(r) for r in wide.collect()} == {
        ("u", 1, 2, None, None), ("v", None, None, 1, None), (None, None, None, None, 1)}
    with pytest.raises(ValueError, match="more than 3"):
        found_classes(df, "clase", 3)
    with pytest.raises(ValueError, match="share"):
        cross_table_found(df, "planta", "clase", label=lambda c: "x")
    assert cross_table_found(df.filter("false"), "planta", "clase").collect() == []


def test_snapshots_one_by_one_equal_the_merge_of_all(spark, tmp_path):
    pick = random.Random(8)
    folder = str(tmp_path / "mezcla")

    def snapshot(columns):
        rows = [(f"k{k}", pick.choice([1, 1, 1, 0, None]), *(pick.choice([None, "x", "y"]) for _ in columns))
                for k in range(60) if pick.random() < 0.7]
        return spark.createDataFrame(rows, f"{KEY} string, RECSTATUS int, " + ", ".join(f"{c} string" for c in columns))

    oldest, middle, newest = snapshot(["a"]), snapshot(["a", "b"]), snapshot(["b", "a"])
    for one in (oldest, middle, newest):
        page_store.merge_snapshot(spark, folder, one, 16)
    whole = snapshot_merge([newest, middle, oldest]).select(KEY, "RECSTATUS", "a", "b")
    stored = page_store.read_merged(spark, folder).select(*whole.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, whole.collect()))
    before = files_of(folder)
    assert page_store.merge_snapshot(spark, folder, newest, 16) == 0 and files_of(folder) == before


def test_a_snapshot_rewrites_only_buckets_of_changed_keys(spark, tmp_path):
    folder = str(tmp_path / "mezcla")
    rows = [(f"k{k}", 1, k) for k in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, f"{KEY} string, RECSTATUS int, n long")
    assert page_store.merge_snapshot(spark, folder, frame(rows), 32) == 300
    before = files_of(folder)
    changed = [*rows[:5], ("k5", 1, 500), ("k6", 0, 6), *rows[7:290], ("new", 1, 1), ("never", 0, 1), (None, 1, 1)]
    assert page_store.merge_snapshot(spark, folder, frame(changed), 32) == 3
    told = {r[KEY]: r.n for r in page_store.read_merged(spark, folder).collect()}
    assert told == {k: n for k, _, n in rows if k != "k6"} | {"k5": 500, "new": 1}
    after = files_of(folder)
    assert len([p for p in before if after.get(p) != before[p]]) <= 3
    last = page_store.merge_snapshot(spark, folder, frame([(k, 0, n) for k, _, n in rows] + [("new", 0, 1)]), 32)
    assert last == 300 and not files_of(folder)
