"""Runs a query and its SQL on the same tables and compares the rows, in any order."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(got: DataFrame, sql: str, folder: str = DATA) -> None:
    want = views(folder).sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b
