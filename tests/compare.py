"""A query's rows beside those of its SQL."""

import glob
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(found, columns):
    names = sorted(columns)
    at = [list(columns).index(c) for c in names]
    return names, sorted(tuple(cell(r[i]) for i in at) for r in found)
