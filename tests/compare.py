"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


_KINDS = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "integer": "INTEGER",
          "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark frame and a DuckDB result; empty when equal."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    spark_names, spark_rows = rows_of(df.columns, df.collect())
    sql_names, sql_rows = rows_of(names, result.fetchall())
    found = []
    if spark_names != sql_names:
        found.append(f"columns {spark_names} <> {sql_names}")
    for field in df.schema:
        kind = _KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if field.name in kinds and kinds[field.name] != kind:
            found.append(f"type of {field.name}: {kind} <> {kinds[field.name]}")
    if spark_rows != sql_rows:
        more, less = spark_rows - sql_rows, sql_rows - spark_rows
        found.append(
            f"rows {sum(spark_rows.values())} <> {sum(sql_rows.values())}; "
            f"only Spark {sum(more.values())} {list(more)[:2]}; "
            f"only SQL {sum(less.values())} {list(less)[:2]}"
        )
    return found
