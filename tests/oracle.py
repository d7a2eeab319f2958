"""Comparing a Spark result with the SQL result of DuckDB on the same files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types of numbers, or rows; empty when equal."""
    found = con.execute(sql)
    want_cols, want = normal([d[0] for d in found.description], found.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(want) != len(got):
        return [f"rows {len(got)} != {len(want)}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w][:5]
