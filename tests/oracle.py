"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        path = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
