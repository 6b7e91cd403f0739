"""Holds a Spark result against the other engine's, row by row, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def same(df, db, sql):
    names = sorted(df.columns)
    left = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = db.execute(sql)
    cols = [d[0] for d in found.description]
    assert sorted(cols) == names
    right = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in found.fetchall()), key=str)
    assert len(left) == len(right)
    assert left == right
