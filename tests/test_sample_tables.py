"""The derivation of slots from line items: nothing is lost or changed without a word."""

import os
import time
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.compare import differences, duck
from wardlens.catalog import tables as t
from wardlens.catalog.oracle import ORACLE_SQL
from wardlens.catalog.queries import QUERIES
from wardlens.operators.slots import organism_rows
from wardlens.plans import outbreak

LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_linestatus string, l_shipdate timestamp"
)


def slots_of(spark, *lines):
    frame = spark.createDataFrame([(1, *line) for line in lines], LINE)
    return t._gathered_slots(lambda name: frame).first()


def test_wide_quantities_and_old_dates_stay_apart(spark):
    row = slots_of(spark, (1, 1, 1, 70.0, "F", datetime(1997, 1, 1)), (1, 1, 2, 3.0, "F", datetime(1969, 12, 1)))
    first, second = row._tiempos[0], row._tiempos[1]
    assert (first.fechaActivacion, first.fechaInactivacion) == (datetime(1997, 1, 1), datetime(1997, 3, 12))
    assert (second.fechaActivacion, second.fechaInactivacion) == (datetime(1969, 12, 1), datetime(1969, 12, 4))


def test_a_missing_part_loses_only_itself(spark):
    row = slots_of(
        spark,
        (3, 8, 1, 5.0, "F", None),
        (None, 9, 2, 5.0, None, datetime(2000, 1, 2)),
        (3, None, 3, None, "F", datetime(2000, 1, 2)),
    )
    assert row._cultivos[0].microorganismo == "Klebsiella pneumoniae" and row._tiempos[0].fechaActivacion is None
    assert row._cultivos[1].microorganismo is None and row._cultivos[1].fechaMuestra == date(2000, 1, 2)
    assert row._cultivos[1].microorganismoEstado == "INACTIVO" and row._camas[1].cama == "B9"
    assert row._tiempos[2].fechaActivacion == datetime(2000, 1, 2) and row._tiempos[2].fechaInactivacion is None
    assert row._cultivos[2].mecanismoMR is None and row._camas[2].cama is None


def test_the_newest_line_of_a_slot_describes_it(spark):
    row = slots_of(
        spark,
        (1, 1, 1, 70.0, "F", datetime(1997, 1, 1)),
        (2, 1, 1, 1.0, "F", datetime(1998, 1, 1)),
        (5, 1, 1, 1.0, "F", None),
    )
    assert row._cultivos[0].microorganismo == t.ORGANISMS[2]


@pytest.mark.parametrize(
    "line",
    [
        (1, 1, 8, 1.0, "F", datetime(1997, 1, 1)),
        (1, 1, None, 1.0, "F", datetime(1997, 1, 1)),
        (1, 1, 1, 1.5, "F", datetime(1997, 1, 1)),
        (1, 1, 1, -1.0, "F", datetime(1997, 1, 1)),
        (1, 1, 1, 1e6, "F", datetime(1997, 1, 1)),
    ],
)
def test_what_does_not_fit_is_an_error(spark, line):
    with pytest.raises(PySparkException, match="lineitem: "):
        slots_of(spark, line)


@pytest.fixture
def other_zone():
    before = os.environ.get("TZ")
    os.environ["TZ"] = "Europe/Madrid"
    time.tzset()
    yield
    if before is None:
        del os.environ["TZ"]
    else:
        os.environ["TZ"] = before
    time.tzset()


@pytest.mark.parametrize(
    "name", ["q24_covid_subsets", "q25_covid_daily_state", "q26_history_upsert", "q40_covid_deaths"]
)
def test_the_cut_off_does_not_follow_the_zone_of_the_process(spark, sample, other_zone, name):
    assert differences(QUERIES[name](spark, sample), duck(sample), ORACLE_SQL[name]) == []


def test_the_cut_off_is_wall_clock_time(spark, other_zone):
    naive = datetime(2022, 7, 26, 13, 50)
    aware = datetime(2022, 7, 26, 15, 50, tzinfo=timezone(timedelta(hours=2)))
    row = spark.range(1).select(
        *[F.date_format(outbreak.wall_clock(m), "yyyy-MM-dd HH:mm") for m in (naive, aware)]
    ).first()
    assert tuple(row) == ("2022-07-26 13:50",) * 2


def test_dates_kept_as_text(spark):
    frame = spark.createDataFrame(
        [("a", "ACTIVO", "X", "2022-03-04", "2022-03-04 10:00:00"), ("b", "ACTIVO", "X", "2022-99-01", "soon")],
        "GlobalRecordId string, microorganismoEstado1 string, microorganismo1 string, fechaMuestra1 string,"
        " fechaActivacion1 string",
    )
    rows = organism_rows(frame, active_only=False, keep_state=True)
    found = {r.GlobalRecordId: (r.fechaMuestra, r.fechaActivacion) for r in rows.collect()}
    assert found == {"a": (date(2022, 3, 4), datetime(2022, 3, 4, 10)), "b": (None, None)}


def test_cases_are_found_before_pages_meet(spark, sample):
    plan = QUERIES["q24_covid_subsets"](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    generate = next(i for i, x in enumerate(lines) if "Generate posexplode" in x)
    depth = lambda x: len(x) - len(x.lstrip(" +-:|"))
    rest = lines[generate + 1 :]
    end = next((i for i, x in enumerate(rest) if depth(x) <= depth(lines[generate])), len(rest))
    below = "\n".join(rest[:end])
    assert "l_orderkey" in below and "Join" not in below
    assert any("Join Inner" in x for x in lines[:generate])
