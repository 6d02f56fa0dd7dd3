"""Comparison of a Spark query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{float(value):.9g}"


def rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(spark, query, sql: str, folder: str) -> None:
    ours = query(spark, folder)
    theirs = connect(folder).execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, ours.collect()) == rows(names, theirs.fetchall())
