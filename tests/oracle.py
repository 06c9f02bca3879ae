"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(names) == columns
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in got)
    assert a == b
    return len(a)
