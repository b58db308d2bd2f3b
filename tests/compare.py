"""Running one query on Spark and its SQL on DuckDB, and comparing columns, types and rows by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _text(v) -> str:
    """One spelling per value; doubles with all their digits, NaN as missing."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v)


def spark_rows(df):
    """(name and type of each column, rows), columns by name and rows in order of their text."""
    columns = sorted((n, TYPES.get(t, t)) for n, t in df.dtypes)
    rows = df.select(*[f"`{n}`" for n, _ in columns]).collect()
    return columns, sorted(tuple(_text(v) for v in r) for r in rows)


def sql_rows(con, sql):
    described = con.execute(f"describe {sql}").fetchall()
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    rows = con.execute(sql).fetchall()
    columns = [(described[i][0], str(described[i][1])) for i in order]
    return columns, sorted(tuple(_text(r[i]) for i in order) for r in rows)


def difference(spark_side, sql_side) -> str | None:
    """None where both sides hold the same rows, else what differs."""
    if spark_side[0] != sql_side[0]:
        return f"columns {set(spark_side[0]) ^ set(sql_side[0])}"
    a, b = spark_side[1], sql_side[1]
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows"
    return next((f"{x} / {y}" for x, y in zip(a, b) if x != y), None)
