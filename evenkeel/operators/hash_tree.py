"""Trees of table fingerprints over ranges of key hashes, to find where two tables differ without reading them.

Rows are dealt into ``FAN ** depth`` ranges by the leading bits of the hash of their key, which are the same for every table. A tree
holds a node for each range and for each group of ``FAN`` neighbours up to the root: row count and summed row hash. Both add
up, so the nodes of a parent, and of a table stored in parts, are sums. Two tables are compared from the root down, below
differing nodes only; then the rows of the ranges that differ are read and compared.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprint import HASH_SUM, hash_sum, row_number_of
from .heat import as_list

FAN_BITS = 4
FAN = 1 << FAN_BITS
DEPTH, MAX_DEPTH = 2, 4
RANGE = "__range"


def range_of(key, depth: int) -> Column:
    """Number of a row's range, from the leading bits of its key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*as_list(key)), 64 - FAN_BITS * depth).cast("int")


def write_by_range(df: DataFrame, path: str, key, depth: int = DEPTH, codec: str = "snappy") -> None:
    """Store a table with a folder for each range; large ranges are written by several tasks."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth {depth} is not between 1 and {MAX_DEPTH}")
    dealt = df.withColumn(RANGE, range_of(key, depth)).hint("rebalance", RANGE)
    dealt.write.option("compression", codec).partitionBy(RANGE).parquet(path)


def write_tree(spark: SparkSession, rows_path: str, path: str, depth: int = DEPTH, scale: int | None = None) -> None:
    """Fingerprints of the stored ranges and of all groups above them; at most ``FAN ** depth`` rows a level."""
    stored = spark.read.parquet(rows_path)
    names = [c for c in stored.columns if c != RANGE]
    leaves = (stored.select(F.col(RANGE).alias("node"), row_number_of(stored, names, scale).alias("__h")).groupBy("node")
              .agg(F.count(F.lit(1)).alias("n_rows"), hash_sum(F.col("__h")).alias("hash_sum")))
    above = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    levels = leaves.select(above, "node", "n_rows", "hash_sum")
    node = F.expr(f"shiftright(node, {FAN_BITS} * ({depth} - level))")
    tree = levels.select("level", node.alias("node"), "n_rows", "hash_sum").groupBy("level", "node").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("hash_sum").cast(HASH_SUM).alias("hash_sum"))
    tree.coalesce(1).sortWithinPartitions("node").write.partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """(level, node, n_rows, hash_sum) of a table stored in parts; None without parts."""
    schema = "node int, n_rows bigint, hash_sum decimal(38,0), level int"
    found = [spark.read.schema(schema).parquet(p) for p in paths]
    if not found:
        return None
    return reduce(DataFrame.unionByName, found).groupBy("level", "node").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("hash_sum").cast(HASH_SUM).alias("hash_sum"))


def differing_ranges(before: DataFrame, after: DataFrame, depth: int) -> list[int]:
    """Ranges at a depth whose fingerprints differ, found from the root down; never more than ``FAN ** MAX_DEPTH`` numbers."""
    nodes = [0]
    for level in range(depth + 1):
        if level:
            nodes = [FAN * n + i for n in nodes for i in range(FAN)]
        here = F.col("level") == level
        if len(nodes) <= FAN ** level // 2:
            here &= F.col("node").isin(nodes)
        a, b = (t.where(here).select("node", F.col("n_rows").alias(f"n{i}"), F.col("hash_sum").alias(f"h{i}")) for i, t in enumerate((before, after)))
        same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("h0").eqNullSafe(F.col("h1"))
        nodes = sorted(r["node"] for r in a.join(b, "node", "full_outer").where(~same).select("node").collect())
        if not nodes:
            return []
    return nodes


def rows_in_ranges(df: DataFrame, ranges: Sequence[int], depth: int, stored_depth: int) -> DataFrame:
    """The rows of some ranges of a table stored by (finer) ranges; the folders of the others are not read."""
    at = F.col(RANGE) if depth == stored_depth else F.shiftright(RANGE, FAN_BITS * (stored_depth - depth))
    return df.where(at.isin(list(ranges))).drop(RANGE)
