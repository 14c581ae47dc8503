"""Compare a query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v: object) -> object:
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int | float | Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    found = connection(sf_dir).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())
