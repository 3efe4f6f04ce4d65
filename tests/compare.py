"""Comparing Spark's rows with DuckDB's."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(found, columns) -> list[str]:
    return sorted(repr(tuple(value(r[c]) for c in columns)) for r in found)


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert rows(df.collect(), columns) == rows(want, columns)
