"""Finding, reading, joining and writing tables."""

from datetime import date

import pytest
from pyspark.sql import types as T

from wardlens import sources
from wardlens.sources import sinks, tables


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS hospital")
    frames = {
        "Vigilancia": spark.createDataFrame([("a", 1), ("b", 0)], "GlobalRecordId string, RECSTATUS int"),
        "Vigilancia1": spark.createDataFrame([("a", "Ana")], "GlobalRecordId string, nombre string"),
        "Vigilancia12": spark.createDataFrame([("b", "x")], "GlobalRecordId string, tipo string"),
        "HospitalPlantas": spark.createDataFrame([("UMI",)], "plantaActual string"),
        "HospitalCamas": spark.createDataFrame([("UMI", 9)], "plantaActual string, nCamas int"),
    }
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(f"hospital.{name}")
    return frames


def test_list_and_load(spark, database):
    names = tables.list_tables(spark, "Vigilancia", "hospital")
    assert names == ["vigilancia", "vigilancia1", "vigilancia12"]
    wide = tables.load_snapshot(spark, "vigilancia", "hospital")
    assert sorted(map(tuple, wide.collect())) == [("a", 1, "Ana", None), ("b", 0, None, "x")]
    assert len(tables.list_tables(spark, database="hospital")) >= 5


def test_pages_that_give_nothing_are_left_out(spark, database):
    pages = {n: database[n] for n in ("Vigilancia", "Vigilancia1", "Vigilancia12")}
    assert list(tables.prune_pages(pages, ["nombre"])) == ["Vigilancia", "Vigilancia1"]
    wide = tables.join_pages(pages, ["nombre"])
    assert wide.columns == ["GlobalRecordId", "nombre"]
    assert sorted(map(tuple, wide.collect()), key=str) == [("a", "Ana"), ("b", None)]


def test_join_pages_null_safe_and_equal_names(spark):
    a = spark.createDataFrame([(None, 1)], "GlobalRecordId string, v int")
    b = spark.createDataFrame([(None, 2)], "GlobalRecordId string, v int")
    assert tables.join_pages({"a": a, "b": b}).first() == (None, 1, None)
    row = tables.join_pages({"a": a, "b": b}, null_safe=True).first()
    assert row.asDict() == {"GlobalRecordId": None, "v_x": 1, "v_y": 2}


def test_choose_table_and_optional_table(spark, database):
    found = tables.first_with_column(
        {n: database[n] for n in ("HospitalPlantas", "HospitalCamas")}, "nCamas"
    )
    assert found.columns == ["plantaActual", "nCamas"]
    assert tables.first_with_column(database, "none") is None
    schema = T.StructType([T.StructField("fecha", T.DateType())])
    missing = tables.fetch_optional(spark, "hospital.nothing", schema)
    assert missing.schema == schema and missing.count() == 0
    assert tables.fetch_optional(spark, "hospital.hospitalcamas", schema).count() == 1


def test_fetch_from_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert tables.fetch_table(spark, str(tmp_path / "t"), "parquet").count() == 3
    assert tables.fetch_table(spark, "hospital.vigilancia").count() == 2


def test_settings_lose_their_quotation_marks(monkeypatch):
    monkeypatch.setenv("RUTA", '"/data/hospital"')
    assert sources.from_environment("RUTA") == "/data/hospital"
    assert sources.from_environment("RUTA_AUSENTE", "x") == "x"
    assert sources.from_environment("RUTA_AUSENTE") is None


def test_write_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "Planta string, n int")
    sinks.write_report({"mapa": df}, str(tmp_path / "p"))
    sinks.write_report({"mapa": df}, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "p" / "mapa")).first() == ("a", 1)
    assert spark.read.csv(str(tmp_path / "c" / "mapa"), header=True).first() == ("a", "1")


def test_safe_replace_may_read_what_it_replaces(spark, database):
    first = spark.createDataFrame([("2022-01-01", 1)], "fecha string, n int")
    sinks.safe_replace(first, "hospital.historico")
    for _ in range(2):
        old = spark.table("hospital.historico")
        sinks.safe_replace(old.filter("n < 5").selectExpr("fecha", "n + 1 AS n"), "hospital.historico")
    table = spark.table("hospital.historico")
    assert table.schema["fecha"].dataType == T.DateType()
    assert [tuple(r) for r in table.collect()] == [(date(2022, 1, 1), 3)]
    names = tables.list_tables(spark, "historico", "hospital")
    assert names == ["historico"]


def test_safe_replace_recovers_a_stopped_run(spark, database):
    start = spark.createDataFrame([(date(2022, 1, 1), 7)], "fecha date, n int")
    sinks.overwrite_table(start, "hospital.parado")
    spark.sql("ALTER TABLE hospital.parado RENAME TO hospital.parado_copia")
    fresh = spark.createDataFrame([(date(2022, 1, 2), 8)], "fecha date, n int")
    sinks.safe_replace(fresh, "hospital.parado")
    assert [r.n for r in spark.table("hospital.parado").collect()] == [8]
    assert tables.list_tables(spark, "parado", "hospital") == ["parado"]


def test_overwrite_days_touches_only_its_days(spark, tmp_path):
    folder = str(tmp_path / "history")
    days = spark.createDataFrame([(date(2022, 1, d), d) for d in (1, 2, 3)], "fecha date, n int")
    sinks.overwrite_days(days, folder)
    again = spark.createDataFrame([(date(2022, 1, 2), 20)], "fecha date, n int")
    for _ in range(2):
        sinks.overwrite_days(again, folder)
    got = spark.read.parquet(folder).orderBy("fecha").collect()
    assert [(r.fecha.day, r.n) for r in got] == [(1, 1), (2, 20), (3, 3)]
    many = spark.range(1000).selectExpr("DATE'2022-01-05' AS fecha", "CAST(id AS INT) AS n")
    sinks.overwrite_days(many, folder)
    assert spark.read.parquet(folder).count() == 1003


def test_durable_stores_columns_in_the_named_folder(spark, tmp_path):
    df = spark.range(5).selectExpr("id * 2 AS x", "id AS y")
    stored = sinks.durable(df, str(tmp_path))
    assert sorted(r.x for r in stored.collect()) == [0, 2, 4, 6, 8]
    plan = stored.filter("y > 3").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "PushedFilters: [IsNotNull(y), GreaterThan(y,3)]" in plan
    assert "ReadSchema: struct<x:bigint>" in stored.select("x")._jdf.queryExecution().executedPlan().toString()
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            sinks.durable(df)
