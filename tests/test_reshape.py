"""Long, wide and cross tables; moving averages, fill-down, smoothing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wardlens.operators import reshape as r
from wardlens.operators import series as s


def test_measures_long_keeps_nulls(spark):
    df = spark.createDataFrame([("d", 1, None)], "fecha string, a int, b int")
    got = r.measures_long(df, ["fecha"], ["a", "b"], "name", "value").collect()
    assert sorted(map(tuple, got)) == [("d", "a", 1), ("d", "b", None)]


def test_metrics_long_is_double(spark):
    row = spark.createDataFrame([(1, 2.5)], "n int, p double")
    got = r.metrics_long(row, ["n", "p"], "id", "v").collect()
    assert sorted(map(tuple, got)) == [("n", 1.0), ("p", 2.5)]


def test_long_and_back(spark):
    long = spark.createDataFrame(
        [("r", 1, "a", "x"), ("r", 1, "b", "y"), ("r", 2, "a", "z")],
        "id string, slot int, name string, value string",
    )
    got = r.long_to_rows(long, ["id", "slot"], ["a", "b"], "name", "value").collect()
    assert sorted(map(tuple, got)) == [("r", 1, "x", "y"), ("r", 2, "z", None)]


def test_cross_table_with_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["u", "v", None]), rng.choice("abc")) for _ in range(200)]
    df = spark.createDataFrame(rows, "ward string, cls string")
    cells = r.cross_table(df, "ward", "cls", ["a", "b", "c", "d"], ["a", "b", "c", "d"])
    table = r.add_total_row(r.add_row_total(cells, list("abcd"), "total"), "ward", [*"abcd", "total"], "all")
    got = {(x._is_total, x.ward): x for x in table.collect()}
    assert set(got) == {(False, "u"), (False, "v"), (False, None), (True, "all")}
    for (is_total, ward), x in got.items():
        for cls in "abcd":
            n = sum(1 for w, k in rows if k == cls and (is_total or w == ward))
            assert x[cls] == (n if n or is_total else None)
        assert x.total == sum(x[cls] or 0 for cls in "abcd")
    assert r.drop_empty(table, list("abcd")).columns == ["ward", "a", "b", "c", "total", "_is_total"]


def test_fill_down_stays_within_a_record(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None), ("b", 2, "y")]
    df = spark.createDataFrame(rows, "id string, pos int, bed string")
    got = {(x.id, x.pos): x.bed for x in s.fill_down(df, "id", ["pos"], "bed").collect()}
    assert got == {("a", 1): None, ("a", 2): "x", ("a", 3): "x", ("b", 1): None, ("b", 2): "y"}


def test_neighbours(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, pos int, v string")
    got = {(x.id, x.pos): (x.v_prev1, x.v_next1) for x in s.neighbours(df, ["id"], ["pos"], "v", [-1, 1]).collect()}
    assert got == {("a", 1): (None, "y"), ("a", 2): ("x", None), ("b", 1): (None, None)}


def test_moving_average_counts_rows_per_series(spark):
    rows = [("s", d, float(v)) for d, v in [(1, 1), (2, 2), (5, 6), (9, 10)]] + [("t", 1, 3.0)]
    df = spark.createDataFrame(rows, "name string, day int, value double")
    got = {(x.name, x.day): x.media_movil for x in s.moving_average(df, "name", "day", "value", 3).collect()}
    assert got == {("s", 1): None, ("s", 2): None, ("s", 5): 3.0, ("s", 9): 6.0, ("t", 1): None}


def brute_force_smooth(x, y, span, points):
    """Direct weighted least squares at every place."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    q = int(np.floor(span * len(x) + 1e-5))
    out = []
    for g in np.linspace(x.min(), x.max(), points):
        d = np.abs(x - g)
        h = np.sort(d)[q - 1]
        near = d < h
        w = np.sqrt((1 - (d[near] / h) ** 3) ** 3)
        basis = np.vander((x[near] - g) / h, 3)
        fit, *_ = np.linalg.lstsq(basis * w[:, None], y[near] * w, rcond=None)
        out.append(fit[2])
    return out


@pytest.mark.parametrize("span", [0.75, 0.4])
def test_smooth_equals_direct_least_squares(spark, span):
    rng = random.Random(11)
    data = {}
    for name, n in (("long", 60), ("short", 17)):
        days = sorted(rng.sample(range(19000, 19120), n))
        data[name] = (days, [rng.uniform(0, 10) for _ in days])
    rows = [(name, d, v) for name, (days, vs) in data.items() for d, v in zip(days, vs)]
    rows.append(("long", 19050, None))  # missing values take no part
    df = spark.createDataFrame(rows, "name string, day int, value double")
    got = s.smooth(df, "name", "day", "value", span, 25).collect()
    assert len(got) == 50
    for name, (days, vs) in data.items():
        fits = [x.ajuste for x in sorted((x for x in got if x.name == name), key=lambda x: x.punto)]
        assert fits == pytest.approx(brute_force_smooth(days, vs, span, 25), abs=1e-8)
