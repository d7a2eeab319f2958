"""Finding keys that are too large for one task.

One cheap pass counts rows per key (combined before the shuffle). A key is hot when it holds more
rows than ``hot_rows`` and more than a 10,000th of the table, so there are never more than 10,000
hot keys: tables with one row per hot key are small enough to broadcast whatever the input.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hot_rows as session_hot_rows

MAX_HOT_KEYS = 10_000


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def same_keys(left: str, right: str, key: Sequence[str]) -> Column:
    """Join condition between two aliases in which NULL keys match each other."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])


def attach(df: DataFrame, small: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """Broadcast-join a table of bounded size on NULL-safe keys, keeping ``key`` once."""
    renamed = small.select(*[F.col(k).alias(f"__r_{k}") if k in key else F.col(k) for k in small.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in key])
    return df.join(F.broadcast(renamed), condition, how).drop(*[f"__r_{k}" for k in key])


# Values of ``hot_rows`` for callers that have already split their rows.
ALL_COLD, ALL_HOT = sys.maxsize, -1


@dataclass(frozen=True)
class HeatSplit:
    """Rows of keys that fit a task, and rows of keys that do not; None where there are none."""

    cold: DataFrame | None
    hot: DataFrame | None


def split_hot(df: DataFrame, key: str | Sequence[str], hot_rows: int | None = None) -> HeatSplit:
    key = as_list(key)
    floor = session_hot_rows(df.sparkSession) if hot_rows is None else hot_rows
    if floor == ALL_COLD:
        return HeatSplit(df, None)
    if floor == ALL_HOT:
        return HeatSplit(None, df)
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
    if largest is None or largest <= floor:
        return HeatSplit(df, None)
    threshold = max(floor, total // MAX_HOT_KEYS)
    found = counts.filter(F.col("__n") > threshold).select(*key).collect()
    if not found:
        return HeatSplit(df, None)
    keys = df.sparkSession.createDataFrame(found, counts.select(*key).schema)
    return HeatSplit(attach(df, keys, key, "left_anti"), attach(df, keys, key, "left_semi"))


def by_heat(df: DataFrame, key: str | Sequence[str], hot_rows: int | None,
            cold: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Treat the rows of ordinary and of hot keys each their own way and stack the results."""
    parts = split_hot(df, key, hot_rows)
    if parts.hot is None:
        return cold(parts.cold)
    if parts.cold is None:
        return hot(parts.hot)
    return cold(parts.cold).unionByName(hot(parts.hot))
