"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def same(spark, sf_dir, f, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in names)) for r in df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(_norm(r[columns.index(c)]) for c in names)) for r in cursor.fetchall())
    assert got == want
