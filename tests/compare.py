"""Rows of Spark and DuckDB in one form."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(x):
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(_plain(r[k]) for k in order) for r in data)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(db, sql):
    found = db.sql(sql)
    return rows(found.columns, found.fetchall())
