"""Compares a query's rows with those of its SQL in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

AT = "/root/testdata/sf0.001"


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(AT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def assert_same_rows(spark, query, sql) -> None:
    df = query(spark, AT)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = connect().execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    places = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[p]) for p in places) for r in found.fetchall())
    assert got == want
