"""Slots: activity rule, duplicates, naming."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import types as T

from wardlens.operators import slots as s

FIELDS = ("microorganismoEstado", "microorganismo", "fechaMuestra", "mecanismoMR", "mecanismoMROtro")
D = date(2022, 1, 1)


def wide(spark, records, n):
    """Records of n slots; each slot is (state, organism, sample date, mechanism, other)."""
    names = ["GlobalRecordId"] + [f"{f}{k}" for k in range(1, n + 1) for f in FIELDS]
    kinds = {"fechaMuestra": T.DateType()}
    schema = T.StructType(
        [T.StructField("GlobalRecordId", T.StringType())]
        + [T.StructField(c, kinds.get(c[:-1], T.StringType())) for c in names[1:]]
    )
    rows = [(key, *[v for slot in slots for v in slot]) for key, slots in records.items()]
    return spark.createDataFrame(rows, schema)


EMPTY = (None,) * 5


def test_slot_columns_come_from_names(spark):
    df = wide(spark, {"r": [EMPTY, EMPTY]}, 2)
    found = s.slot_columns(df)
    assert list(found) == [1, 2]
    assert found[2]["estadoAislamiento"] == "microorganismoEstado2"
    assert found[1]["otroMecanismo"] == "mecanismoMROtro1"
    assert found[1]["mecanismoMR"] == "mecanismoMR1"


def organisms(df, **options):
    rows = s.organism_rows(df, **options).collect()
    return sorted((r.GlobalRecordId, r.slot, r.microorganismo) for r in rows)


def test_activity_rule_cases(spark):
    df = wide(
        spark,
        {
            "full": [("ACTIVO", "Serratia", D, "AmpC", "x")],
            "undated": [("ACTIVO", "Serratia", None, "AmpC", "x")],
            "closed": [("INACTIVO", "Serratia", D, "AmpC", "x")],
            "stateless": [(None, "Serratia", D, "AmpC", "x")],
            "nameless": [("ACTIVO", None, D, "AmpC", "x")],
        },
        1,
    )
    rows = {r.GlobalRecordId: r for r in s.organism_rows(df).collect()}
    assert set(rows) == {"full", "undated"}
    assert rows["full"].microorganismo == "Serratia AmpC"
    assert (rows["full"].fechaMuestra, rows["full"].otroMecanismo) == (D, "x")
    # a missing sample date also blanks what comes after it
    assert rows["undated"].microorganismo == "Serratia"
    assert (rows["undated"].fechaMuestra, rows["undated"].otroMecanismo) == (None, None)


def test_rule_needs_states(spark):
    df = spark.createDataFrame([("r", "x")], "GlobalRecordId string, microorganismo1 string")
    with pytest.raises(ValueError):
        s.organism_rows(df)


def test_duplicates_go_before_mechanisms_are_shortened(spark):
    df = wide(
        spark,
        {
            "variants": [
                ("ACTIVO", "Klebsiella", D, "BLEE tipo 1", None),
                ("ACTIVO", "Klebsiella", D, "BLEE tipo 2", None),
                ("ACTIVO", "Klebsiella", D, "BLEE tipo 1", "later"),
            ],
            "dead first": [
                ("INACTIVO", "Klebsiella", D, None, None),
                ("ACTIVO", "Klebsiella", D, None, None),
                ("ACTIVO", "Klebsiella", D, None, None),
            ],
        },
        3,
    )
    assert organisms(df) == [
        ("dead first", 2, "Klebsiella"),
        ("variants", 1, "Klebsiella BLEE"),
        ("variants", 2, "Klebsiella BLEE"),
    ]
    # without the rule the first slot counts too
    assert ("dead first", 1, "Klebsiella") in organisms(df, active_only=False)


def test_names_and_labels(spark):
    cases = {
        "a": ("Clostridium difficile", None, "Clostridioides difficile"),
        "b": ("E. coli", "R = 3 grupos", "E. coli MR"),
        "c": ("E. coli", "Carbapenemasa", "E. coli p. de carbapenemasa"),
        "d": ("E. coli", "R meticilina/oxacilina", "E. coli R meticilina"),
        "e": ("E. coli", "unknown", "E. coli"),
        "f": ("Enterococcus R vancomicina", "AmpC", "Enterococcus R vancomicina AmpC"),
    }
    df = wide(spark, {k: [("ACTIVO", o, D, m, None)] for k, (o, m, _) in cases.items()}, 1)
    assert organisms(df) == [(k, 1, name) for k, (_, _, name) in cases.items()]
    without = s.organism_rows(df, mechanisms=s.MECHANISMS[:4], keep_mechanism=True)
    last = {r.GlobalRecordId: r for r in without.collect()}["f"]
    assert (last.microorganismo, last.mecanismoMR) == ("Enterococcus R vancomicina", None)


def test_more_than_nine_slots(spark):
    columns, values = ["GlobalRecordId"], ["r"]
    for k in range(1, 13):
        columns += [f"microorganismoEstado{k}", f"microorganismo{k}", f"fechaMuestra{k}", f"mecanismoMR{k}"]
        values += ["ACTIVO", f"O{k % 11}", "2022-01-01", "AmpC"]
    df = spark.createDataFrame([tuple(values)], columns)
    found = s.organism_rows(df).collect()
    assert sorted(r.slot for r in found) == list(range(1, 12))  # slot 12 repeats slot 1
    assert {r.microorganismo for r in found} == {f"O{i} AmpC" for i in range(11)}


def test_records_without_organisms_can_stay(spark):
    df = wide(spark, {"none": [EMPTY, EMPTY], "one": [EMPTY, ("ACTIVO", "X", D, None, None)]}, 2)
    assert organisms(df) == [("one", 2, "X")]
    assert sorted(organisms(df, keep_empty=True), key=str) == [("none", None, None), ("one", 2, "X")]


def literal_activity(record):
    """The rule as neighbouring-row passes over the rows of all slots (plain Python)."""
    rows = [(n, p, v) for n, slot in enumerate(record) for p, v in enumerate(slot)]
    value = [v for _, _, v in rows]
    after = value[1:] + [None]
    value = [None if v == "ACTIVO" and nxt is None else v for v, nxt in zip(value, after)]
    for back in (1, 2, 3):
        before = [None, *value[:-1]]
        result = []
        for i, (n, p, _) in enumerate(rows):
            same = i >= back and rows[i - back][0] == n
            if p == 0 or not same:
                result.append(value[i])
            else:
                result.append(None if before[i] in (None, "INACTIVO") else value[i])
        value = result
    return {(n + 1, p): v for (n, p, _), v in zip(rows, value) if v not in (None, "INACTIVO")}


def test_activity_rule_equals_the_passes(spark):
    rng = random.Random(7)
    pick = [
        lambda: rng.choice(["ACTIVO", "ACTIVO", "INACTIVO", None, "PENDIENTE"]),
        lambda: rng.choice(["A", "B", None]),
        lambda: rng.choice([D, None]),
        lambda: rng.choice(["AmpC", "Otro", None]),
        lambda: rng.choice(["x", None]),
    ]
    records = {f"r{i}": [tuple(f() for f in pick) for _ in range(3)] for i in range(600)}
    order = ("estadoAislamiento", "microorganismo", "fechaMuestra", "mecanismoMR", "otroMecanismo")
    expected = {
        (key, slot, order[p], str(v))
        for key, record in records.items()
        for (slot, p), v in literal_activity(record).items()
    }
    got = s.active_slots_long(wide(spark, records, 3)).collect()
    assert {(r.GlobalRecordId, r.slot, r.name, r.value) for r in got} == expected
    assert len(got) == len(expected)


def test_join_organisms_equals_the_built_in_join(spark):
    df = wide(spark, {"a": [("ACTIVO", "X", D, None, None)], "b": [EMPTY]}, 1)
    stored = s.organism_rows(df)
    records = df.select("GlobalRecordId")
    direct = s.organism_rows(df, keep_empty=True)
    for null_safe in (False, True):
        joined = s.join_organisms(records, stored, null_safe=null_safe)
        assert sorted(map(str, joined.select(direct.columns).collect())) == sorted(
            map(str, direct.collect())
        )


def test_no_shuffle_and_no_python(spark):
    df = wide(spark, {"a": [("ACTIVO", "X", D, None, None)]}, 1)
    plan = s.organism_rows(df, keep_empty=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan
