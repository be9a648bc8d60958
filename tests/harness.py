"""Row sets of Spark and DuckDB results, compared without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    have = [d[0] for d in found.description]
    names = sorted(have)
    places = [have.index(c) for c in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in places)) for r in found.fetchall())


def assert_same(df, con, sql):
    got, want = spark_rows(df), sql_rows(con, sql)
    assert got[0] == want[0]
    assert got[1] == want[1]
