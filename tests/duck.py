"""Compares a query's rows with its SQL twin in DuckDB."""

import decimal
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(repr([_norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    got = sorted(repr([_norm(r[c]) for c in cols]) for r in df.collect())
    assert got == want
