"""Report runs over catalog tables, each run twice on one day."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlens.catalog import tables as t
from wardlens.plans import reports, runs
from wardlens.sources import fetch_table


@pytest.fixture(scope="module")
def database(spark, sample):
    spark.sql("CREATE DATABASE IF NOT EXISTS informe")
    # pages as they are stored: moments with a time zone
    for name, page in t.pages(spark, sample).items():
        few = page.filter("GlobalRecordId % 4 = 0")
        moments = [f.name for f in few.schema if f.dataType.simpleString() == "timestamp_ntz"]
        few = few.withColumns({c: F.col(c).cast("timestamp") for c in moments})
        few.write.mode("overwrite").saveAsTable(f"informe.{name}")
    t.wards(spark, sample).write.mode("overwrite").saveAsTable("informe.HospitalCamas")
    spark.sql("SELECT 'x' AS sala").write.mode("overwrite").saveAsTable("informe.HospitalAreas")
    t.results(spark, sample).write.mode("overwrite").saveAsTable("informe.indicadores_resultados")
    spark.sql("DROP TABLE IF EXISTS informe.covid_historico")
    return "informe"


def rows(spark, folder):
    return sorted(map(str, spark.read.parquet(str(folder)).collect()))


def twice(spark, run, tmp_path):
    """The tables of both runs, which must be the same."""
    outs = [tmp_path / "first", tmp_path / "second"]
    for out in outs:
        run(str(out))
    names = sorted(p.name for p in outs[0].iterdir())
    found = [{n: rows(spark, out / n) for n in names} for out in outs]
    assert found[0] == found[1] and names
    return found[0]


def test_isolation(spark, database, tmp_path):
    day = date(2026, 12, 2)
    found = twice(
        spark, lambda out: runs.run_isolation(spark, day, out, database, str(tmp_path / "s")), tmp_path
    )
    assert {"mapa", "criticos", "hospitalizacion", "indicadores", "presion"} <= set(found)
    assert len(found["mapa"]) > 2 and len(found["criticos"]) > 0


def test_cleaning_and_critical(spark, database, tmp_path):
    found = twice(spark, lambda out: runs.run_cleaning(spark, out, database), tmp_path / "a")
    assert set(found) == {"criticos", "hospitalizacion"}
    found = twice(spark, lambda out: runs.run_critical(spark, out, database), tmp_path / "b")
    assert found["criticos"]


def test_covid_keeps_one_row_per_day(spark, database, tmp_path):
    def run(out, day=date(2024, 1, 15)):
        runs.run_covid(spark, t.COVID_CUTOFF, day, date(2024, 1, 10), out, database, str(tmp_path))

    twice(spark, run, tmp_path / "runs")
    assert fetch_table(spark, "informe.covid_historico").count() == 1
    run(str(tmp_path / "next"), date(2024, 1, 16))
    stored = fetch_table(spark, "informe.covid_historico").orderBy("fecha").collect()
    assert [r.fecha for r in stored] == [date(2024, 1, 15), date(2024, 1, 16)]


def test_merge(spark, database, tmp_path):
    found = twice(
        spark, lambda out: runs.run_merge(spark, [database, database], out, str(tmp_path)), tmp_path
    )
    assert set(found) == {"total", "informe", "movimientos"} and found["total"]


def test_missing_tables_are_named(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS vacio")
    with pytest.raises(ValueError, match="Vigilancia"):
        runs.read_pages(spark, "vacio")
    with pytest.raises(ValueError, match="nCamas"):
        runs.ward_table(spark, "vacio")


def test_reading_over_jdbc_must_be_split(spark):
    with pytest.raises(ValueError, match="numPartitions"):
        fetch_table(spark, "Vigilancia", "jdbc", url="jdbc:x")


def test_classes_that_never_occur_are_not_printed(spark):
    columns = ["n_pacientes int", "planta string", *[f"{c} int" for c in _labels()], "total_unidad int"]
    row = (1, "UMI", *[2 if i == 1 else None for i in range(len(_labels()))], 2)
    shown = reports.printed({"mapa": spark.createDataFrame([row], ", ".join(columns))})["mapa"]
    assert len(shown.columns) == 4


def _labels():
    from wardlens.plans.isolation import CLASS_COLUMNS

    return list(CLASS_COLUMNS.values())
