"""Comparison of a frame with the same query in DuckDB."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    left = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    right = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert left == right
