"""COVID subsets, state, history; bed movements; retention; whole reports."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardlens.operators.keys import drop_known
from wardlens.plans import movements, outbreak, reports, retention, trends

CUT = datetime(2022, 7, 26, 13, 50)
BEFORE, AFTER = datetime(2022, 7, 26, 13), datetime(2022, 7, 26, 14)
COVID = "Virus SARS-CoV-2 (COVID-19)"

CASE = (
    "id string, aSIP string, aNHC string, estadoActual string, estadoAislamiento string, "
    "plantaActual string, camaActual string, INGRESO string, motivoRetirada string, "
    "ingresoPorCovid string, fechaActivacion timestamp, fechaInactivacion timestamp, fechaMuestra date"
)


@pytest.fixture(scope="module")
def cases(spark):
    first, again = "Primer ingreso", "Reingreso"
    rows = [
        ("in", "s1", "1", "ACTIVO", "ACTIVO", "H1", "C1", first, None, "SI", BEFORE, None, date(2022, 7, 1)),
        ("critical", "s2", "2", "ACTIVO", "ACTIVO", "UMI", "C2", again, None, None, AFTER, None, date(2022, 7, 18)),
        ("new", "s3", "3", "ACTIVO", "ACTIVO", "UMI 2", "C3", first, None, "DUDOSO", AFTER, None, None),
        ("out", "s4", "4", "INACTIVO", "INACTIVO", "H1", "C4", first, "ALTA", "NO", BEFORE, AFTER, None),
        ("no reason", "s5", "5", "INACTIVO", "INACTIVO", "H1", "C5", first, None, "SI", BEFORE, AFTER, None),
        ("dead", "s6", "6", "INACTIVO", "INACTIVO", "H1", "C6", first, "EXITUS", "SI", BEFORE, AFTER, None),
        ("dead of other", "s7", "7", "INACTIVO", "INACTIVO", "H1", "C7", first, "EXITUS", "NO", BEFORE, AFTER, None),
        ("out long ago", "s8", "8", "INACTIVO", "INACTIVO", "H1", "C8", first, "ALTA", "NO", BEFORE, BEFORE, None),
        ("closed slot", "s9", "9", "ACTIVO", "INACTIVO", None, "C9", first, None, "SI", AFTER, None, None),
    ]
    return spark.createDataFrame(rows, CASE)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_subsets(cases):
    expected = {
        "total_ingresados": ["critical", "in", "new"],
        "total_criticos": ["critical"],
        "casos_nuevos": ["new"],
        "altas": ["out"],
        "exitus": ["dead"],
    }
    for name, members in expected.items():
        assert ids(outbreak.case_subset(cases, name, CUT)) == members
    found = sorted((r.grupo, r.id) for r in outbreak.case_subsets(cases, CUT).collect())
    assert found == sorted((g, m) for g, members in expected.items() for m in members)
    assert tuple(outbreak.death_details(cases, CUT).first()) == ("s6", "26-07-2022")


def test_state_and_lists(cases):
    day = date(2022, 7, 28)
    state = outbreak.daily_state(cases, CUT, day).first()
    assert tuple(state) == (day, 3, 1, 1, 1, 1, 1, 0)
    assert outbreak.daily_state(cases.filter("false"), CUT, day).first().total_ingresados == 0
    assert {tuple(r) for r in outbreak.admitted_per_ward(cases).collect()} == {
        ("H1", 1), ("UMI", 1), ("UMI 2", 1)}
    assert sorted(r.SIP for r in outbreak.doubtful_cause(cases).collect()) == ["s2", "s3"]
    waited = outbreak.long_positive(cases, day).collect()
    assert [(r.Cama, r.dias_positivo) for r in waited] == [("C1", 27), ("C2", 10)]


def test_history_series(spark):
    rows = [(datetime(2022, 3, d), d, d * 2, 1, 1, 0) for d in range(1, 6)]
    history = spark.createDataFrame(
        rows,
        "fecha timestamp, total_ingresados int, total_criticos int, casos_nuevos int, altas int, exitus int",
    )
    assert outbreak.occupancy_series(history).count() == 10
    assert outbreak.occupancy_series(history, date(2022, 3, 4)).count() == 4
    assert outbreak.incidence_series(history, date(2022, 3, 5)).count() == 2
    assert outbreak.axis_end(history).first().fecha_max == date(2022, 3, 12)
    undated = history.union(spark.createDataFrame([(None, 0, 0, 0, 0, 0)], history.schema))
    assert outbreak.axis_end(undated).first().fecha_max is None


def movement_rows(spark, record):
    row = {"GlobalRecordId": "r", "aSIP": "s", "aNHC": "n", "fechaAlta": None,
           **{f"{c}{k}": None for k in (1, 2, 3) for c in ("fechaIngreso", "cama")}, **record}
    schema = ", ".join(f"{c} {'date' if c.startswith('fecha') else 'string'}" for c in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    got = sorted(movements.bed_movements(df).collect(), key=lambda r: r.orden)
    return [(r.tipo, r.cama, r.fecha.day) for r in got]


def day(n):
    return date(2022, 1, n)


def test_bed_movements(spark):
    full = {"fechaIngreso1": day(1), "cama1": "A", "fechaIngreso2": day(2), "cama2": "B",
            "fechaIngreso3": day(3), "fechaAlta": day(4)}
    assert movement_rows(spark, full) == [
        ("ingreso", "A", 1), ("movimiento", "B", 2), ("movimiento", "B", 3), ("alta", "B", 4)]
    # no bed before the first one; an undated entry drops out with its bed
    assert movement_rows(spark, {"fechaIngreso1": day(1), "cama2": "B", "fechaAlta": day(4)}) == [
        ("ingreso", None, 1), ("alta", None, 4)]
    # a repeated entry is dropped before beds are carried forward
    again = {"fechaIngreso1": day(1), "cama1": "A", "fechaIngreso2": day(2), "cama2": "B",
             "fechaIngreso3": day(2), "cama3": "B", "fechaAlta": day(4)}
    assert movement_rows(spark, again) == [
        ("ingreso", "A", 1), ("movimiento", "B", 2), ("alta", "B", 4)]
    assert movement_rows(spark, {"fechaAlta": day(4)}) == [("alta", None, 4)]
    assert movement_rows(spark, {}) == []


@pytest.fixture(scope="module")
def form(spark):
    old, new = datetime(2022, 1, 1), datetime(2023, 6, 1)
    main = spark.createDataFrame(
        [("keep", 1, "ACTIVO", old), ("closed", 1, "INACTIVO", old), ("closed new", 1, "INACTIVO", new),
         ("nobody", 1, "ACTIVO", old), ("stateless", 1, None, old), ("deleted", 0, "ACTIVO", new)],
        "GlobalRecordId string, RECSTATUS int, estadoActual string, LastSaveTime timestamp",
    )
    people = spark.createDataFrame(
        [("keep", "a", "1"), ("closed", "b", "2"), ("closed new", None, "3"), ("nobody", "d", None),
         ("stateless", "e", "5"), ("deleted", "f", "6"), ("orphan", "g", "7")],
        "GlobalRecordId string, nombre string, aNHC string",
    )
    extra = spark.createDataFrame([("closed", 1), ("keep", 2), ("orphan", 3)], "GlobalRecordId string, x int")
    return {"Vigilancia": main, "Vigilancia1": people, "Vigilancia12": extra}


def keys(df):
    return sorted(r.GlobalRecordId for r in df.collect())


def test_purge_removes_old_closed_records_everywhere(form):
    cutoff = date(2023, 1, 1)
    assert keys(retention.records_to_purge(form, cutoff)) == ["closed", "nobody"]
    kept = retention.purge(form, cutoff)
    assert keys(kept["Vigilancia"]) == ["closed new", "deleted", "keep", "stateless"]
    assert keys(kept["Vigilancia1"]) == ["closed new", "deleted", "keep", "stateless"]
    assert keys(kept["Vigilancia12"]) == ["keep"]
    for page in list(kept.values())[1:]:
        assert drop_known(page, kept["Vigilancia"]).count() == 0
    assert keys(retention.orphans(form)["Vigilancia1"]) == ["orphan"]
    newest = retention.last_change(retention.closed_records(form)).first()
    assert newest.ultimo == datetime(2023, 6, 1)


def test_stored_keys_give_the_same_pages(form, tmp_path):
    cutoff, folder = date(2023, 1, 1), str(tmp_path)
    for run in (lambda folder: retention.purge(form, cutoff, folder),
                lambda folder: retention.repair(form, "Vigilancia1", folder)):
        stored, plain = run(folder), run(None)
        assert {n: sorted(p.collect()) for n, p in stored.items()} == {
            n: sorted(p.collect()) for n, p in plain.items()}
        # later pages read the stored keys; the joins that found them are not run again
        plan = stored["Vigilancia12"]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1


def test_first_page_is_purged_without_joining_itself(form):
    plan = retention.purged_first_page(form, date(2023, 1, 1))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join") == 1


def test_repair_keeps_valid_named_records(form):
    clean = retention.repair(form, "Vigilancia1")
    assert keys(clean["Vigilancia"]) == ["closed", "keep", "nobody", "stateless"]
    assert keys(clean["Vigilancia12"]) == ["closed", "keep"]


def test_trend_series(spark):
    names = ["pa_global", "pa_crit", "pa_hosp", "pa_covid", "pa_aisl_nosocomial",
             "pa_cauris", "pa_carba", "pa_acineto", "pa_cdif"]
    rows = [(date(2022, 1, d), 10, None if d == 2 else 3, *[float(d)] * 9) for d in (2, 1)]
    results = spark.createDataFrame(
        rows, "fecha date, n_aisl_totales int, n_covid int, " + ", ".join(f"{n} double" for n in names)
    )
    totals = trends.isolation_series(results).collect()
    assert [r.n_covid for r in totals] == [3.0, pytest.approx(19.46)]
    assert [r.year for r in totals] == ["2022", "2022"]
    assert trends.pressure_series(results).count() == 8
    resistant = trends.resistant_series(results)
    labels = dict(map(tuple, resistant.select("pa_mr_name", "etiqueta").distinct().collect()))
    assert labels["pa_acineto"] == "Acinetobacter baumanii" and len(labels) == 4
    assert [r.pa_mr_name for r in trends.series_names(resistant, "pa_mr_name").collect()] == sorted(labels)
    # two days do not make a parabola
    short = trends.smooth_series(results, ["pa_crit"]).collect()
    assert len(short) == 80 and all(r.ajuste is None for r in short)


def test_whole_reports(spark, sample, tmp_path):
    from wardlens.catalog import tables as t
    from wardlens.plans.indicators import indicator_names

    form = t.pages(spark, sample)
    assert reports.is_full_report(date(2026, 12, 2)) and not reports.is_full_report(date(2026, 12, 3))
    names = indicator_names(t.metadata(spark), "posicion")
    args = (form, t.wards(spark, sample), names, t.results(spark, sample))
    folder = str(tmp_path)
    full = reports.isolation_report(*args, date(2026, 12, 2), folder)
    plain = reports.isolation_report(*args, date(2026, 12, 3))
    assert set(plain) == {"mapa", "criticos", "hospitalizacion"} < set(full)
    assert full["mapa"].collect() == plain["mapa"].collect()
    assert full["indicadores"].count() == 27
    shown = reports.printed(full)
    assert shown["mapa"].columns[:3] == ["Nº ptes. aislados", "Planta", "C. auris"]
    assert shown["indicadores"].columns == ["Indicador", "Cálculo", "Resultado"]
    assert full["resistentes_suavizado"].count() == 4 * 80
    clean = reports.cleaning_report(form, folder)
    assert all(df.columns == ["Cama"] and df.count() for df in clean.values())
    assert reports.critical_report(form)["criticos"].count() == plain["criticos"].count()

    covid = reports.covid_report(
        form, t.history(spark, sample), t.COVID_CUTOFF, t.HISTORY_DAY, t.HISTORY_START, folder=folder
    )
    assert covid["historico"].count() == 30
    assert reports.printed(covid)["por_planta"].columns == ["Planta", "Nº de ingresados"]
    assert covid["historico"].filter(F.col("ingresados_por_covid").isNotNull()).count() == 1
    assert covid["curva_parcial"].filter("media_movil IS NULL").count() == 12

    wide = t.surveillance(
        spark, sample, t.STATUS_PAGE.keys() | t.PATIENT_PAGE.keys() | t.ISOLATION_PAGE.keys(), "."
    )
    merged = reports.merged_report([wide.filter("GlobalRecordId % 2 = 0"), wide], folder)
    assert merged["total"].count() == wide.filter("RECSTATUS = 1").count()
    assert merged["informe"].count() >= merged["total"].count()
    assert merged["movimientos"].count() > 0
