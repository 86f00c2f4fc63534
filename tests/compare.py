"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb

FOLDER = os.environ.get("POSTMILL_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(cols, rows):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(df, sql, folder=FOLDER):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    other = c.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(other.columns, other.fetchall())
