"""Runs a query in Spark and its SQL in DuckDB and compares their rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
