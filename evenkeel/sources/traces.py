"""Trace tables in shards of a fixed number of records per key."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.heat import as_list
from ..operators.ordered import shard_index
from .artifacts import TIME_FORMATS


def write_trace(df: DataFrame, path: str, key, order_by, seed: int, n: int = 512, shard_dirs: bool = False,
                hot_rows: int | None = None) -> None:
    """Write records as JSON below ``seed=...``, each with its ``shard`` number within its key.

    A shard's records lie together in one file, in order. ``shard_dirs`` also gives each shard number
    a directory of its own: handy for a few runs, too many small files for a large table.
    """
    key, order_by = as_list(key), as_list(order_by)
    sharded = shard_index(df, key, order_by, n, "shard", hot_rows).withColumn("seed", F.lit(seed))
    placed = sharded.repartition(*key, "shard").sortWithinPartitions(*key, "shard", *order_by)
    dirs = ["seed", "shard"] if shard_dirs else ["seed"]
    placed.write.mode("overwrite").partitionBy(*dirs).options(**TIME_FORMATS).json(path)


def read_trace(spark: SparkSession, path: str, schema: T.StructType, seeds: Sequence[int] | None = None) -> DataFrame:
    """Read shards with an explicit schema; ``seeds`` prunes directories."""
    full = T.StructType([f for f in schema.fields if f.name not in ("seed", "shard")]
                        + [T.StructField("shard", T.LongType()), T.StructField("seed", T.LongType())])
    trace = spark.read.schema(full).options(mode="FAILFAST", **TIME_FORMATS).json(path)
    return trace if seeds is None else trace.filter(F.col("seed").isin(list(seeds)))
