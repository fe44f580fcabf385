"""Runs a query and its SQL over the same tables and compares rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):  # noqa: ANN001, ANN201
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (decimal.Decimal, int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:  # noqa: ANN001
    """'' when both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    rel = connect(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    a, b = rows(df.columns, df.collect()), rows(list(rel.columns), rel.fetchall())
    if a == b:
        return ""
    return f"{len(a)} rows against {len(b)}; only in the query: {[x for x in a if x not in set(b)][:3]}; only in the SQL: {[x for x in b if x not in set(a)][:3]}"
