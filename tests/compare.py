"""Rows of a query and of its SQL in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = con.sql(sql)
    columns = sorted(out.columns)
    at = [list(out.columns).index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
