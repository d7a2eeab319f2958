"""Comparing tables and manifests."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint import hash_sum, row_number_of
from .heat import as_list


def snapshot_diff(before: DataFrame, after: DataFrame, key, scale: int | None = None,
                  exclude: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``added``, ``removed``, ``changed`` or ``same``.

    Both tables are reduced to (key, row hash), stacked, and summed per key before the shuffle, so a
    key that appears many times is compared as a multiset and never joined with itself.
    """
    key = as_list(key)
    names = [c for c in before.columns if c not in set(exclude)]

    def side(df: DataFrame, is_after: bool) -> DataFrame:
        return df.select(*key, row_number_of(df, names, scale).alias("__h"), F.lit(is_after).alias("__after"))

    old, new = F.when(~F.col("__after"), F.col("__h")), F.when(F.col("__after"), F.col("__h"))
    sums = side(before, False).unionByName(side(after, True)).groupBy(*key).agg(
        F.count(old).alias("__n0"), F.count(new).alias("__n1"),
        hash_sum(old).alias("__h0"), hash_sum(new).alias("__h1"))
    status = (F.when(F.col("__n0") == 0, "added").when(F.col("__n1") == 0, "removed")
              .when((F.col("__n0") == F.col("__n1")) & (F.col("__h0") == F.col("__h1")), "same")
              .otherwise("changed"))
    return sums.select(*key, status.alias("status"))


def _same_key(key: list[str]):
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]


def added_rows(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """Rows of ``after`` whose key ``before`` does not have; without hashing, null keys are equal."""
    return after.alias("a").join(before.select(*as_list(key)).alias("b"), _same_key(as_list(key)), "left_anti")


def removed_rows(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """Rows of ``before`` whose key ``after`` does not have."""
    return added_rows(after, before, key)


def kept_rows(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """Rows of ``after`` whose key ``before`` has as well, changed or not."""
    return after.alias("a").join(before.select(*as_list(key)).alias("b"), _same_key(as_list(key)), "left_semi")


def compare_manifests(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Status of each table of a snapshot: ``ok``, ``changed``, ``missing`` or ``extra``."""
    a, b = stored.alias("a"), computed.alias("b")
    equal = ((F.col("a.n_rows") == F.col("b.n_rows")) & (F.col("a.hash_sum") == F.col("b.hash_sum"))
             & (F.col("a.schema_hash") == F.col("b.schema_hash")))
    status = (F.when(F.col("b.table").isNull(), "missing").when(F.col("a.table").isNull(), "extra")
              .when(equal, "ok").otherwise("changed"))
    return (a.join(b, F.col("a.table") == F.col("b.table"), "full_outer")
            .select(F.coalesce("a.table", "b.table").alias("table"), status.alias("status"),
                    F.col("a.n_rows").alias("stored_rows"), F.col("b.n_rows").alias("computed_rows")))
