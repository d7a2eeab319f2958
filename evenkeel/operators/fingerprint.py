"""Fingerprints of tables that do not depend on row order, column order or partitioning.

They detect accidents and drift; they are not a cryptographic commitment.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import fingerprint_number, row_fingerprint, schema_digest
from .heat import as_list

HASH_SUM = T.DecimalType(38, 0)


def hash_sum(number: Column) -> Column:
    """Exact sum of row numbers: a hash of a multiset of rows."""
    return F.coalesce(F.sum(number), F.lit(0).cast(HASH_SUM)).cast(HASH_SUM)


def row_number_of(df: DataFrame, cols: Sequence[str], scale: int | None) -> Column:
    """A row's number in the sum. Select it before summing: decimal sums read their input repeatedly."""
    return fingerprint_number(row_fingerprint(df, cols, scale))


def _columns(df: DataFrame, cols: Sequence[str] | None, exclude: Sequence[str]) -> list[str]:
    return [c for c in (cols or df.columns) if c not in set(exclude)]


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = (),
                      scale: int | None = None) -> DataFrame:
    """One row: row count, hash of the rows as a multiset, and hash of the schema.

    One pass with map-side sums; nothing but one row per task is shuffled. Leave out columns of
    wall-clock time with ``exclude``.
    """
    names = _columns(df, cols, exclude)
    return (df.select(row_number_of(df, names, scale).alias("__h"))
            .agg(F.count(F.lit(1)).alias("n_rows"), hash_sum(F.col("__h")).alias("hash_sum"))
            .withColumn("schema_hash", F.lit(schema_digest(df, names))))


def grouped_fingerprint(df: DataFrame, by, exclude: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """The same per group; fingerprint the result once more to get one hash over all groups."""
    by = as_list(by)
    names = [c for c in _columns(df, None, exclude) if c not in by]
    return df.select(*by, row_number_of(df, names, scale).alias("__h")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), hash_sum(F.col("__h")).alias("hash_sum"))


def nested_fingerprint(df: DataFrame, by, exclude: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    return table_fingerprint(grouped_fingerprint(df, by, exclude, scale))
