"""The confidence band of the smoothed curve against numpy."""

import math

import numpy as np
import pytest

from wardlens.operators.series import smooth, smooth_band


def student(p, df):
    """The quantile of Student's t, by bisection of its integrated density."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t):
        x = np.linspace(0, t, 100_001)
        return 0.5 + np.trapezoid(scale * (1 + x * x / df) ** (-(df + 1) / 2), x)

    low, high = 1.0, 6.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def weights(xs, at, q):
    d = np.abs(xs - at)
    h = np.sort(d)[q - 1]
    w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
    design = np.stack([np.ones(len(xs)), xs - at, (xs - at) ** 2], axis=1)
    return np.linalg.solve(design.T @ (w[:, None] * design), design.T * w)[0]


@pytest.mark.parametrize("n, days", [(30, 1), (45, 2)])
def test_band_equals_numpy(spark, n, days):
    rng = np.random.default_rng(n)
    series = {"a": rng.normal(0, 2, n), "b": np.sin(np.arange(n) / 5) * 10 + rng.normal(0, 1, n)}
    xs = np.arange(n, dtype=float) * days + rng.integers(0, 2, n) * 0.25
    rows = [(s, float(x), float(v)) for s, ys in series.items() for x, v in zip(xs, ys)]
    rows += [("a", None, 1.0), ("b", 3.0, None)]
    df = spark.createDataFrame(rows, "serie string, x double, y double")
    found = {(r.serie, r.punto): r for r in smooth_band(df, "serie", "x", "y").collect()}
    curve = {(r.serie, r.punto): r.ajuste for r in smooth(df, "serie", "x", "y").collect()}
    assert found.keys() == curve.keys() and len(found) == 160
    q = math.floor(0.75 * n + 1e-5)
    matrix = np.stack([weights(xs, x, q) for x in xs])
    rest = (np.eye(n) - matrix) @ (np.eye(n) - matrix).T
    d1, d2 = np.trace(rest), np.trace(rest @ rest)
    t = student(0.975, d1**2 / d2)
    for (s, k), r in found.items():
        row = weights(xs, xs[0] + k * (xs[-1] - xs[0]) / 79, q)
        scale = math.sqrt(((series[s] - matrix @ series[s]) ** 2).sum() / d1)
        fit, reach = row @ series[s], t * scale * np.linalg.norm(row)
        assert abs(r.ajuste - fit) < 1e-6 and abs(curve[s, k] - r.ajuste) < 1e-9
        assert abs(r.lo - (fit - reach)) < 1e-6 and abs(r.hi - (fit + reach)) < 1e-6


def test_too_few_observations_have_no_band(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0)], "serie string, x double, y double")
    rows = smooth_band(df, "serie", "x", "y").collect()
    assert all(r.ajuste is None and r.lo is None and r.hi is None for r in rows)
    assert smooth_band(df.filter("false"), "serie", "x", "y").collect() == []
