"""Moving averages, fill-down and smoothing of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlens.constants import NORMAL_975, SMOOTH_POINTS, SMOOTH_SPAN


def fill_down(df: DataFrame, key: str, order: Sequence[str | Column], col: str) -> DataFrame:
    """Replace nulls by the last value before them within one record."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(before))


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], col: str, offsets: Sequence[int]
) -> DataFrame:
    """Values of earlier (negative offset) and later rows of the same record.

    They are added as ``<col>_prev<n>`` and ``<col>_next<n>``.
    """
    by_key = W.partitionBy(*keys).orderBy(*order)
    shifted = {
        f"{col}_{'next' if n > 0 else 'prev'}{abs(n)}": F.lag(col, -n).over(by_key) for n in offsets
    }
    return df.withColumns(shifted)


def moving_average(
    df: DataFrame, series: str, order: str, value: str, n: int, name: str = "media_movil"
) -> DataFrame:
    """Mean over the last ``n`` rows of each series; null before the n-th row.

    A series has one row per calendar day, so a partition holds a few hundred rows
    per year however much data was counted into it.
    """
    last_n = W.partitionBy(series).orderBy(order).rowsBetween(-(n - 1), W.currentRow)
    full = F.count(value).over(last_n) == n
    return df.withColumn(name, F.when(full, F.avg(value).over(last_n)))


def smooth(
    df: DataFrame,
    series: str,
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
) -> DataFrame:
    """Local quadratic regression per series at ``points`` equally spaced places.

    Each fitted value comes from the nearest ``floor(span * n)`` observations with
    tricube weights. Every observation is sent to a fixed number of places and
    summed there before the shuffle, so the work grows with the observations, not
    with their square. Returns (series, punto, x, ajuste); ``ajuste`` is null where
    the observations do not determine a parabola.
    """
    obs = df.select(
        F.col(series), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).dropna()

    rank = W.partitionBy(series).orderBy("_x", "_y")
    whole = W.partitionBy(series)
    ranked = obs.select(
        "*",
        F.row_number().over(rank).alias("_r"),
        F.count("*").over(whole).alias("_n"),
        F.min("_x").over(whole).alias("_lo"),
        F.max("_x").over(whole).alias("_hi"),
    ).withColumn("_q", F.greatest(F.lit(1), F.floor(F.lit(span) * F.col("_n") + 1e-5)))

    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    ends = ranked.select(
        series, (F.col("_r") - F.col("_q") + 1).alias("_start"), F.col("_x").alias("_end")
    )
    spans = (
        ranked.withColumn("_start", F.col("_r").cast("long"))
        .join(ends, [series, "_start"])
        .select(series, "_x", "_end", "_lo", step.alias("_step"))
    )
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("punto")
    at = F.col("_lo") + F.col("punto") * F.col("_step")

    # half-width at a place: the tightest run of q observations around it
    reach = F.greatest(at - F.col("_x"), F.col("_end") - at)
    widths = (
        spans.select("*", place)
        .withColumn("_reach", reach)
        .groupBy(series, "punto")
        .agg(F.min("_reach").alias("_h"))
    )

    spread = ranked.select(series, "_x", "_y", "_lo", step.alias("_step"), place)
    u = F.try_divide(F.col("_x") - at, F.col("_h"))  # null where all neighbours share one x
    near = (
        spread.join(widths, [series, "punto"])
        .select(series, "punto", at.alias("x"), "_y", u.alias("_u"))
        .withColumn("_inside", F.greatest(1 - F.pow(F.abs("_u"), F.lit(3.0)), F.lit(0.0)))
        .withColumn("_w", F.pow("_inside", F.lit(3.0)))
    )
    power = [F.col("_w") * F.pow(F.col("_u"), F.lit(float(k))) for k in range(5)]
    sums = near.groupBy(series, "punto").agg(
        F.max("x").alias("x"),
        *[F.sum(p).alias(f"s{k}") for k, p in enumerate(power)],
        *[F.sum(p * F.col("_y")).alias(f"t{k}") for k, p in enumerate(power[:3])],
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (
        F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")
    )
    a, b, c = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    det = s0 * a - s1 * b + s2 * c
    fit = F.try_divide(t0 * a - t1 * b + t2 * c, det)
    solvable = F.abs(det) > F.lit(1e-12) * s0 * s0 * s0
    return sums.select(series, "punto", "x", F.when(solvable, fit).alias("ajuste"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _product(left: Column, right: Column) -> Column:
    return _total(F.zip_with(left, right, lambda a, b: a * b))


def t_quantile(z: float, freedom: Column) -> Column:
    """The quantile of Student's t where the normal one is ``z``, by its expansion in 1 / degrees of freedom.

    It holds to 1e-6 from 15 degrees on and to 1e-5 from 10.
    """
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return sum((F.lit(t) / F.pow(freedom, F.lit(float(k))) for k, t in enumerate(terms)), F.lit(0.0))


def smooth_band(
    df: DataFrame,
    series: str,
    x: str,
    y: str,
    span: float = SMOOTH_SPAN,
    points: int = SMOOTH_POINTS,
    z: float = NORMAL_975,
) -> DataFrame:
    """The curve of :func:`smooth` with its confidence band: (series, punto, x, ajuste, lo, hi).

    A fitted value is a weighted sum of the observations; the weights at the observations are the rows of
    the operator matrix L. With R = I - L, d1 = tr(R R') and d2 = tr((R R')^2), the residual scale is
    sqrt(sum of squared residuals / d1), and the band reaches t scale |weights| to both sides, t with
    d1^2 / d2 degrees of freedom (95 % by default).

    A series has one row per calendar day, however much data was counted into it, and the matrix one row per
    day: rows are arrays of that length, dealt over the tasks, and d2 takes the products of all pairs of them.
    ``lo`` and ``hi`` are null where the fit is, or where the observations leave no freedom.
    """
    obs = df.select(
        F.col(series), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).dropna()
    each = obs.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("_x", "_y"))).alias("_o"))
    n = F.size("_xs")
    each = each.select(series, F.col("_o._x").alias("_xs"), F.col("_o._y").alias("_ys")).select(
        "*",
        F.greatest(F.lit(1), F.floor(F.lit(span) * n + 1e-5)).cast("int").alias("_q"),
        ((F.element_at("_xs", -1) - F.col("_xs")[0]) / F.lit(float(points - 1))).alias("_step"),
    )
    # places of the curve first, then the observations themselves
    targets = each.select("*", F.explode(F.sequence(F.lit(0), n + (points - 1))).alias("_t"))
    place = F.col("_t") < points
    at = F.when(place, F.col("_xs")[0] + F.col("_t") * F.col("_step")).otherwise(F.get("_xs", F.col("_t") - points))
    near = targets.withColumn("_at", at).withColumn(
        "_h", F.array_sort(F.transform("_xs", lambda v: F.abs(v - F.col("_at"))))[F.col("_q") - 1]
    )
    near = near.withColumn("_u", F.transform("_xs", lambda v: F.try_divide(v - F.col("_at"), F.col("_h"))))
    inside = lambda u: F.greatest(1 - F.pow(F.abs(u), F.lit(3.0)), F.lit(0.0))
    near = near.withColumn("_w", F.transform("_u", lambda u: F.pow(inside(u), F.lit(3.0))))
    power = lambda k: F.transform("_u", lambda u: F.pow(u, F.lit(float(k))))
    near = near.select("*", *[_product(F.col("_w"), power(k)).alias(f"_s{k}") for k in range(5)])
    s0, s1, s2, s3, s4 = (F.col(f"_s{k}") for k in range(5))
    near = near.select(
        series, "_t", "_at", "_ys", "_u", "_w", s0.alias("_s0"),
        (s2 * s4 - s3 * s3).alias("_a"), (s1 * s4 - s2 * s3).alias("_b"), (s1 * s3 - s2 * s2).alias("_c"),
        (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)).alias("_det"),
    )
    solvable = F.abs("_det") > F.lit(1e-12) * F.pow("_s0", F.lit(3.0))
    weight = lambda w, u: w * (F.col("_a") - F.col("_b") * u + F.col("_c") * u * u) / F.col("_det")
    near = near.withColumn("_l", F.when(solvable, F.zip_with("_w", "_u", weight)))
    fitted = near.select(
        series, "_t", F.col("_at").alias("x"), "_ys", "_l",
        _product(F.col("_l"), F.col("_ys")).alias("ajuste"), F.sqrt(_product(F.col("_l"), F.col("_l"))).alias("_norm"),
    )
    own = F.col("_t") - points
    rest = F.transform("_l", lambda v, i: F.when(i == own, 1.0).otherwise(0.0) - v)
    rows = fitted.filter(~place).select(
        series, "_t", rest.alias("_r"), (F.get("_ys", own) - F.col("ajuste")).alias("_e")
    )
    scale = rows.groupBy(series).agg(
        F.sum(F.col("_e") * F.col("_e")).alias("_rss"), F.sum(_product(F.col("_r"), F.col("_r"))).alias("_d1")
    )
    other = rows.select(F.col(series).alias("_of"), F.col("_r").alias("_r2"))
    dots = rows.join(other, F.col(series).eqNullSafe(F.col("_of")))
    dots = dots.select(series, _product(F.col("_r"), F.col("_r2")).alias("_m"))
    second = dots.groupBy(F.col(series).alias("_of")).agg(F.sum(F.col("_m") * F.col("_m")).alias("_d2"))
    told = scale.join(second, F.col(series).eqNullSafe(F.col("_of"))).select(
        F.col(series).alias("_of"),
        F.sqrt(F.try_divide("_rss", "_d1")).alias("_s"),
        F.try_divide(F.col("_d1") * F.col("_d1"), F.col("_d2")).alias("_df"),
    )
    curve = fitted.filter(place).join(told, F.col(series).eqNullSafe(F.col("_of")))
    reach = t_quantile(z, F.when(F.col("_df") > 0, F.col("_df"))) * F.col("_s") * F.col("_norm")
    return curve.select(
        series, F.col("_t").alias("punto"), "x", "ajuste",
        (F.col("ajuste") - reach).alias("lo"), (F.col("ajuste") + reach).alias("hi"),
    )
