"""Runs a query and its SQL and brings both into one form."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def form(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql: str, sf_dir: str = DATA) -> None:
    df = query(spark, sf_dir)
    got = form(df.columns, [tuple(r) for r in df.collect()])
    said = con.execute(sql)
    assert got == form([c[0] for c in said.description], said.fetchall())
