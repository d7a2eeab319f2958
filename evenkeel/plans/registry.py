"""Registration of queries and small helpers shared by the catalogue."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Two-decimal inputs put means and variances exactly on rounding ties, where engines differ in the
# last bit. Adding this before rounding, on both sides, moves them off the tie.
OFF_TIE = 3e-7

ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def off_tie(col) -> Column:
    return F.round((F.col(col) if isinstance(col, str) else col) + F.lit(OFF_TIE), 4)


def sql_off_tie(expr: str) -> str:
    return f"round({expr} + {OFF_TIE}, 4)"


def sql_uniform(seed: int, domain: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}|{domain}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def sql_uniform_int(lo: str, hi: str, seed: int, domain: str, *keys: str) -> str:
    return f"({lo} + floor({sql_uniform(seed, domain, *keys)} * ({hi} - {lo})))::BIGINT"


def with_bad_values(events: DataFrame) -> DataFrame:
    """Events with NaN and infinities put in at places given by the event id."""
    m = F.col("event_id") % 11
    return events.withColumn("value", F.when(m == 3, float("nan")).when(m == 5, float("inf"))
                             .when(m == 7, float("-inf")).otherwise(F.col("value")))


SQL_BAD_VALUES = """(select event_id, ts, user_id, event_type, props,
    case event_id % 11 when 3 then 'nan'::DOUBLE when 5 then 'inf'::DOUBLE when 7 then '-inf'::DOUBLE
         else value end as value from events)"""
