"""Canonical text of values and rows, for fingerprints."""

from __future__ import annotations

import hashlib
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_MARK = "\u001f"
NULL_MARK = "\u001e"
_ESCAPED_FIELD = "\u001e\u001d"


def _float_token(c: Column, scale: int | None) -> Column:
    if scale is None:
        text = (c + F.lit(0.0)).cast("string")
    else:
        exact = c.try_cast(T.DecimalType(38, scale))
        text = F.coalesce(exact.cast("string"), c.cast("string"))
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c), "NaN").when(c == inf, "InfPos").when(c == -inf, "InfNeg").otherwise(text)


def canonical_token(col: Column, dtype: T.DataType, scale: int | None = None, nested: bool = False) -> Column:
    """Text of a value that is the same on every engine and layout.

    ``scale`` rounds floating values to that many decimals. Texts inside arrays and structs carry
    their length, so that no two different values share a token.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        token = _float_token(col.cast("double"), scale)
    elif isinstance(dtype, T.TimestampNTZType):
        token = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dtype, T.TimestampType):
        token = F.unix_micros(col).cast("string")
    elif isinstance(dtype, T.BinaryType):
        token = F.hex(col)
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: canonical_token(x, dtype.elementType, scale, nested=True))
        token = F.concat(F.lit(f"{dtype.elementType.simpleString()}:"), F.size(col).cast("string"), F.lit(";"),
                         F.array_join(items, ","))
    elif isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        return canonical_token(F.array_sort(F.map_entries(col)), T.ArrayType(entry), scale, nested)
    elif isinstance(dtype, T.StructType):
        parts = []
        for field in sorted(dtype.fields, key=lambda f: f.name):
            parts += [F.lit(field.name), canonical_token(col[field.name], field.dataType, scale, nested=True)]
        token = F.when(col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(dtype, T.StringType) and nested:
        token = F.concat(F.length(col).cast("string"), F.lit(":"), col)
    elif isinstance(dtype, T.StringType):
        token = F.replace(F.replace(col, F.lit(NULL_MARK), F.lit(NULL_MARK * 2)),
                          F.lit(FIELD_MARK), F.lit(_ESCAPED_FIELD))
    else:
        token = col.cast("string")
    return F.coalesce(token, F.lit(NULL_MARK))


def row_text(df: DataFrame, cols: Sequence[str] | None = None, scale: int | None = None) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in sorted(cols or df.columns):
        parts += [F.lit(name), canonical_token(F.col(f"`{name}`"), types[name], scale)]
    return F.concat_ws(FIELD_MARK, *parts)


def row_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, scale: int | None = None) -> Column:
    """SHA-256 over the sorted name/value tokens of a row; column order plays no part."""
    return F.sha2(row_text(df, cols, scale), 256)


def fingerprint_number(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a decimal, ready to be summed."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").cast("decimal(28,0)")


def schema_digest(df: DataFrame, cols: Sequence[str] | None = None) -> str:
    names = set(cols or df.columns)
    text = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name in names))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
