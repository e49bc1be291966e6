"""Comparison of a query with its DuckDB counterpart."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def check(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert got == want
