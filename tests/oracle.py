"""Comparison of a query with its SQL."""

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return ("x", None if math.isnan(v) else float(f"{v:.9g}"))
    if isinstance(v, decimal.Decimal):
        return ("x", float(f"{float(v):.9g}"))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    assert rows == wanted
