"""Shaping records: redaction, nesting, vocabularies."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .heat import ALL_HOT
from .ordered import number_rows

# Types whose values may be shown.
SIMPLE_TYPES = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string")


def redact(df: DataFrame, allow: Sequence[str], allow_types: Sequence[str] = SIMPLE_TYPES) -> DataFrame:
    """Columns that are both named and of an allowed type pass; the others show only their type."""
    def shown(field):
        kind = field.dataType.simpleString()
        if field.name in allow and kind in allow_types:
            return F.col(field.name)
        return F.to_json(F.struct(F.lit(kind).alias("__type__"))).alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def redact_nested(df: DataFrame, allow: Sequence[str], allow_types: Sequence[str] = SIMPLE_TYPES) -> DataFrame:
    """The same at every depth: allowed columns are rebuilt, and names and types are applied to what they hold.

    Fields of structs are named; elements of arrays go by the name of their array. Keys of maps are names: entries with other keys are
    left out, since a key may itself tell something, and maps whose keys are no strings show only their type.
    """
    return df.select(*[_shown(F.col(f"`{f.name}`"), f.name, f.dataType, set(allow), set(allow_types)).alias(f.name) for f in df.schema.fields])


def _shown(value: Column, name: str, dtype: T.DataType, allow: set[str], types: set[str]) -> Column:
    kind = dtype.simpleString()
    tag = F.to_json(F.struct(F.lit(kind).alias("__type__")))
    if name not in allow:
        return tag
    if isinstance(dtype, T.StructType):
        fields = [_shown(value[f.name], f.name, f.dataType, allow, types).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _shown(x, name, dtype.elementType, allow, types))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        kept = F.map_filter(value, lambda k, _: k.isin(sorted(allow)))
        return F.transform_values(kept, lambda _, v: _shown(v, name, dtype.valueType, allow, types))
    return value if kind in types else tag


def nested_record(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Pack columns into named records, keeping the others."""
    packed = {c for cols in groups.values() for c in cols}
    return df.select(*[c for c in df.columns if c not in packed],
                     *[F.struct(*cols).alias(name) for name, cols in groups.items()])


def flatten_record(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[f"{n}.*" for n in names])


# For a list on the driver; ``learn_codes`` has no such limit.
MAX_VOCABULARY = 100_000


def learn_vocabulary(df: DataFrame, col: str) -> list:
    """The distinct values of a column in order, NULL left out."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_VOCABULARY + 1).collect()
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"{col} has more than {MAX_VOCABULARY} values")
    return sorted(r[0] for r in found)


def learn_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """(value, code) of the distinct values in order, NULL left out, for any number of them.

    Values are dealt by range over many tasks, numbered within each, and what earlier tasks hold is carried over; nothing of it
    passes through the driver.
    """
    found = df.select(F.col(col)).where(F.col(col).isNotNull()).distinct().withColumn("__all", F.lit(0))
    numbered = number_rows(found, "__all", col, "__code", hot_rows=ALL_HOT)
    return numbered.select(F.col(col), (F.col("__code") - 1).alias(name))


def encode_learned(df: DataFrame, col: str, name: str = "code", vocabulary: list | None = None) -> DataFrame:
    """Position of each value among the distinct values of the column, or in a given list; others give NULL."""
    if vocabulary is None:
        codes = learn_codes(df, col, name).withColumnRenamed(col, "__word")
        return df.join(codes, F.col(col) == F.col("__word"), "left").drop("__word")
    kind = df.schema[col].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(zip(vocabulary, range(len(vocabulary)))), f"__word {kind}, {name} bigint")
    return df.join(F.broadcast(table), F.col(col) == F.col("__word"), "left").drop("__word")
