"""Cohorts, ward tables, resistant organisms, map, cleaning list, listings, indicators."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardlens.constants import CLASSES, MDR_PATTERNS_NARROW
from wardlens.plans import indicators as ind
from wardlens.plans import isolation as iso

ROWS = (
    "GlobalRecordId string, slot int, plantaActual string, NHC string, camaActual string, "
    "motivoAislamiento string, tipoAislamiento string, origenInfeccion string, "
    "microorganismo string, fechaMuestra date, otroMecanismo string"
)


def ward_rows(spark, rows):
    """Rows given as (record, ward, patient, bed, type, origin, organism)."""
    full = [
        (rid, i + 1, ward, nhc, bed, "M", kind, origin, organism, None, None)
        for i, (rid, ward, nhc, bed, kind, origin, organism) in enumerate(rows)
    ]
    return spark.createDataFrame(full, ROWS)


def of_organisms(spark, *names):
    return ward_rows(spark, [("r", "UMI", "1", "C1", "Gotas", None, n) for n in names])


def names(df):
    return [r.microorganismo for r in df.collect()]


def test_cohorts(spark):
    df = spark.createDataFrame(
        [(1, "ACTIVO", "a"), (0, "ACTIVO", "a"), (1, "INACTIVO", "a"), (1, None, "a"),
         (None, "ACTIVO", "a"), (1, "ACTIVO", None)],
        "RECSTATUS int, estadoActual string, nombre string",
    )
    assert iso.valid_records(df).count() == 4
    assert iso.active_records(df).count() == 1


def wide_record(spark):
    row = {
        "GlobalRecordId": "r", "RECSTATUS": 1, "plantaActual": "UMI", "aNHC": "7",
        "camaActual": "C1", "motivoAislamiento": "COLONIZACIÓN/otra", "tipoAislamiento": "CONTACTO/GOTAS",
        "origenInfeccion": "NOSOCOMIAL", "microorganismoEstado1": "ACTIVO",
        "microorganismo1": "Serratia marcescens", "fechaMuestra1": date(2022, 1, 1),
        "mecanismoMR1": "AmpC", "mecanismoMROtro1": "x", "sexo": "Mujer",
        "fechaNacimiento": datetime(1980, 1, 1), "fechaIngreso1": datetime(2022, 1, 1),
        "fechaAislamiento": datetime(2022, 1, 1, 12), "fechaRetirada": datetime(2022, 1, 4, 6),
        **dict.fromkeys(iso.RISK_FACTORS, "NO"),
    }
    return spark.createDataFrame([tuple(row.values())], list(row))


def test_ward_table_texts_and_names(spark):
    row = iso.ward_table(wide_record(spark)).first()
    assert row.tipoAislamiento == "Contacto/Gotas"
    assert row.motivoAislamiento == "Colonización/Otra"
    assert row.origenInfeccion == "Nosocomial"
    assert (row.NHC, row.microorganismo) == ("7", "Serratia marcescens AmpC")


def test_enriched_table_age_and_days(spark):
    row = iso.enriched_table(wide_record(spark)).first()
    assert row.edad_al_ingreso == 42.0
    assert row.dias_aislado == 2
    assert row.mecanismoMR == "AmpC"
    assert "fechaNacimiento" not in row.asDict()


def test_resistant_list(spark):
    every = ["X BLEE", "X MR", "X p. de carbapenemasa", "E R vancomicina", "C difficile",
             "S R meticilina", "Candida auris", "Serratia marcescens", "X AmpC",
             "Stenotrophomonas maltophilia", "Virus MR", "Otro virus BLEE", "R meticilina x", None]
    kept = names(iso.resistant_list(of_organisms(spark, *every)))
    assert kept == every[:10]
    narrow = names(iso.resistant_list(of_organisms(spark, *every), MDR_PATTERNS_NARROW))
    assert narrow == every[:8]


def test_report_classes_first_rule_wins(spark):
    cases = {
        "Candida auris": "C. auris", "Candida auris MR": "MMR", "X p. de carbapenemasa": "EPC",
        "Serratia marcescens BLEE": "BLEE", "S R meticilina": "R meticilina",
        "Clostridioides difficile": "C. difficile", "Serratia marcescens": "Otros",
        "Stenotrophomonas maltophilia": "Otros", "X AmpC": "Otros", "E R vancomicina": None,
    }
    df = of_organisms(spark, *cases).select("microorganismo", iso.report_class(F.col("microorganismo")))
    assert dict(map(tuple, df.collect())) == cases
    counts = dict(map(tuple, iso.resistant_classes(of_organisms(spark, *cases)).collect()))
    assert counts["NA"] == 1 and counts["Otros"] == 3


def brute_force_map(rows):
    """Counts from the rule book: rows are (record, ward, patient, ..., organism) in order."""
    classes = {"MR": "mmr", "BLEE": "blee", "vancomicina": "na", "AmpC": "otros"}
    table, seen, patients = {}, set(), {}
    for rid, ward, nhc, *_, organism in rows:
        cell = table.setdefault(ward, {})
        name = classes[organism.split()[-1]]
        cell[name] = cell.get(name, 0) + 1
        if nhc not in seen:
            seen.add(nhc)
            patients[ward] = patients.get(ward, 0) + 1
    return table, patients


def test_isolation_map_equals_brute_force(spark):
    rng = random.Random(5)
    organisms = ["A MR", "A BLEE", "E R vancomicina", "A AmpC"]
    records = []
    for i in range(300):
        ward, nhc = rng.choice(["UMI", "H1", "H2", None]), rng.choice([None, None, *map(str, range(60))])
        for _ in range(rng.randint(1, 3)):
            records.append((f"r{i:04d}", ward, nhc, "C", "Gotas", None, rng.choice(organisms)))
    # a ward whose only patient is counted elsewhere
    records.append(("r9999", "H9", records[0][2], "C", "Gotas", None, "A MR"))
    df = ward_rows(spark, records)
    got = iso.sorted_isolation_map(df).collect()
    table, patients = brute_force_map(records)
    assert [r.planta for r in got] == ["H1", "H2", "H9", "UMI", None, "Total por MMR"]
    for r in got[:-1]:
        cells = {c: r[c] for c in ("mmr", "blee", "na", "otros")}
        assert cells == {c: table[r.planta].get(c) for c in cells}
        assert r.total_unidad == sum(table[r.planta].values())
        assert r.n_pacientes == patients.get(r.planta)
    total = got[-1]
    assert got[2].n_pacientes is None and total.c_auris == 0
    for column in ("n_pacientes", "mmr", "blee", "na", "otros", "total_unidad"):
        assert total[column] == sum(r[column] or 0 for r in got[:-1])
    firsts = {r.plantaActual: r.n for r in iso.patients_per_ward(df).collect()}
    assert firsts == patients
    assert len(iso.CLASS_COLUMNS) == len(CLASSES)


def test_cleaning_list(spark):
    df = ward_rows(
        spark,
        [
            ("a", "UMI 2", "1", "C1", None, None, "Candida auris"),
            ("b", "H1", "1", None, None, None, "Clostridioides difficile"),
            ("c", None, "1", "C3", None, None, "Candida auris"),
            ("d", "H1", "1", "C4", None, None, "Candida auris MR"),
            ("e", "H1", "1", "C5", None, None, None),
            ("f", "H1", "1", None, None, None, "Clostridioides difficile"),
        ],
    )
    got = sorted((r.area, r.Cama) for r in iso.cleaning_list(df).collect())
    assert got == [("criticos", "C1¹"), ("hospitalizacion", "NA²"), ("hospitalizacion", "NA²")]


def test_ward_listing(spark):
    df = ward_rows(
        spark,
        [
            ("a", "UMI", "1", "C2", None, None, None),
            ("b", "UMI", "2", "C1", None, None, None),
            ("c", "H1", "3", "C1", None, None, None),
            ("d", None, "4", "C1", None, None, None),
        ],
    )
    assert [r.NHC for r in iso.ward_listing(df, ["UMI"]).collect()] == ["2", "1"]
    assert [r.NHC for r in iso.ward_listing(df, ["UMI"], within=False).collect()] == ["3"]


@pytest.fixture(scope="module")
def wards(spark):
    return spark.createDataFrame(
        [("UMI", "CRITICOS", 10), ("H1", "HOSP", 30), ("H2", "HOSP", None)],
        "plantaActual string, areaHospital string, nCamas int",
    )


def test_indicators(spark, wards):
    df = ward_rows(
        spark,
        [
            ("a", "UMI", "1", "C1", "Contacto/Gotas", "Nosocomial", "Virus SARS-CoV-2 (COVID-19)"),
            ("a", "UMI", "1", "C1", "Contacto/Gotas", "Nosocomial", "X p. de carbapenemasa"),
            ("b", "H1", "2", None, "Gotas", None, "Virus Influenza A"),
            ("c", "H1", "3", "C2", "Contacto", "Comunitario", "Candida auris"),
            ("d", None, "4", "C2", None, "Nosocomial", "Clostridioides difficile"),
            ("e", "H9", "5", None, "Gotas", None, None),
        ],
    )
    row = ind.indicators(df, wards, date(2022, 7, 27)).first()
    assert row.n_aisl_totales == 3  # C1, C2 and the missing bed
    assert (row.n_aisl_hosp, row.n_aisl_crit) == (2, 1)
    assert row.n_aisl_nosocomial == 3  # rows, not beds
    assert (row.total_camas, row.total_camas_hosp, row.total_camas_crit) == (40, 30, 10)
    assert (row.n_virus_resp_total, row.n_virus_resp, row.n_covid) == (2, 1, 1)
    assert (row.n_carba, row.n_cauris, row.n_cdif, row.n_acineto) == (1, 1, 1, 0)
    assert row.pa_global == pytest.approx(7.5)
    assert row.razon_covid_resp == 1.0
    assert row.ta_aisl_nosocomial == pytest.approx(100.0)
    assert len(row) == 28 and set(ind.METRICS) < set(row.asDict())


def test_indicators_of_nothing(spark, wards):
    row = ind.indicators(ward_rows(spark, []), wards, date(2022, 7, 27)).first()
    assert row.n_aisl_totales == 0 and row.pa_global == 0.0
    assert row.razon_covid_resp is None and row.ta_virus_resp is None


def test_indicator_table_prints_by_first_rule(spark, wards):
    df = ward_rows(spark, [("a", "UMI", "1", "C1", "Gotas", None, "X p. de carbapenemasa")])
    rows = [(2, "n_carba", "Carba", "a / b"), (1, "n_aisl_totales", "Total", "n"),
            (3, "pa_global", "Presión", "x"), (4, "razon_covid_resp", "Razón", "y"),
            (5, "total_camas", "Camas", "z"), (6, "unknown", "-", "-")]
    meta = spark.createDataFrame(rows, "pos int, id_indicador string, indicador string, calculo string")
    metrics = ind.indicators(df, wards, date(2022, 7, 27))
    got = ind.indicator_table(metrics, ind.indicator_names(meta, "pos")).collect()
    assert [(r.indicador, r.calculo, r.resultado) for r in got] == [
        ("Total", "n", " 1"),
        ("Carba", "a /\nb", "1.000%"),
        ("Presión", "x", "2.50%"),
        ("Razón", "y", "NA"),
        ("Camas", "z", None),
    ]


def test_rows_per_bed_origin(spark):
    df = ward_rows(
        spark,
        [("a", "H1", "1", "C1", None, "Nosocomial", "X"), ("b", "H1", "1", "C1", None, None, "Y")],
    )
    assert tuple(ind.rows_per_bed_origin(df).first()) == ("C1", 2, 1, 50.0)
