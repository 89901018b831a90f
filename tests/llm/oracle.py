"""A query's rows beside those of its SQL."""

import glob
import os

import duckdb
import pandas as pd


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def frame(rows, columns):
    f = pd.DataFrame([list(r) for r in rows], columns=list(columns))[sorted(columns)]
    return f.astype(str).sort_values(sorted(columns)).reset_index(drop=True)


def same(spark, d, query, sql):
    df = query(spark, d)
    got = frame(df.collect(), df.columns)
    want = connect(d).sql(sql)
    want = frame(want.fetchall(), want.columns)
    pd.testing.assert_frame_equal(got, want)
    return len(got)
