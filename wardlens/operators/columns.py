"""Choosing, ordering and changing columns by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starting_with(df: DataFrame, *texts: str) -> list[str]:
    """Names that start with a text; prefix by prefix, ignoring case."""
    found = [c for t in texts for c in df.columns if c.lower().startswith(t.lower())]
    return list(dict.fromkeys(found))


def ending_with(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c.lower().endswith(text.lower())]


def containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text.lower() in c.lower()]


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def relocate(df: DataFrame, *cols: str, after: str | None = None) -> DataFrame:
    """Move columns to the front, or behind another column."""
    rest = [c for c in df.columns if c not in cols]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*rest[:at], *cols, *rest[at:])


def across(
    df: DataFrame, cols: Iterable[str], change: Callable[[Column], Column]
) -> DataFrame:
    """Apply one function to many columns in place."""
    return df.withColumns({c: change(F.col(c)) for c in cols})


def derive(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Add columns one after the other, so that later ones may use earlier ones."""
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df


def present(df: DataFrame, names: Mapping[str, str], *order: Column) -> DataFrame:
    """The columns of a printed table under their printed names, sorted."""
    rows = df.orderBy(*order) if order else df
    return rows.select(*[F.col(c).alias(shown) for c, shown in names.items()])
