"""Runs a query and its DuckDB SQL over the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(columns, names, data):
    at = [names.index(c) for c in columns]
    return sorted(tuple(_plain(r[i]) for i in at) for r in data)


def compare(spark, con, folder, run, sql):
    df = run(spark, str(folder))
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    got, want = rows_of(columns, df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, names, found.fetchall())
    assert got == want
    return len(got)
