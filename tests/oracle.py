"""Compare a query with its checking SQL: columns, row count and values."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _kind(v):
    return "null" if v is None else type(v).__name__


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Problems found; empty if both sides agree."""
    rel = con.sql(sql)
    want_names, want = list(rel.columns), rel.fetchall()
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    problems = []
    if sorted(want_names) != sorted(got_names):
        return [f"columns {sorted(got_names)} expected {sorted(want_names)}"]
    if len(want) != len(got):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    for n in want_names:
        a = {_kind(r[got_names.index(n)]) for r in got} - {"null"}
        b = {_kind(r[want_names.index(n)]) for r in want} - {"null"}
        if a and b and a != b:
            problems.append(f"{n}: types {a} expected {b}")
    have, need = rows_of(got_names, got), rows_of(want_names, want)
    if have != need:
        extra, missing = list((have - need).items())[:3], list((need - have).items())[:3]
        problems.append(f"values differ; only here: {extra}; only in SQL: {missing}")
    return problems
