"""Runs a query and its SQL over one folder, and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def same(spark, name, run, sql, folder):
    df = run(spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = duck(folder).sql(sql)
    assert sorted(rel.columns) == cols
    theirs = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall()), key=str)
    assert len(ours) == len(theirs), name
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (name, cols, a, b)
    return len(ours)
