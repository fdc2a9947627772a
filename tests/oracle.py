"""Comparison of a query with its SQL in DuckDB, by values without order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(names: list[str], values: list) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


def plain(r: tuple) -> tuple:
    return tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows(df.columns, [plain(tuple(r)) for r in df.collect()])
    want = rows(rel.columns, [plain(r) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
