"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def same(df, connection, sql):
    r = connection.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
    got = sorted(str(tuple(x)) for x in df.collect())
    assert got == want
