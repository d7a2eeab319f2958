"""JSON artifacts with columns in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Without them Spark cuts times in JSON to milliseconds.
TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_json_artifact(df: DataFrame, path: str) -> None:
    """One JSON record per line. NaN and infinities become text tokens that read back as numbers;
    Spark's commit protocol makes the files visible only when all are written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").options(ignoreNullFields="false", **TIME_FORMATS).json(path)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read records of a known schema; a malformed record is an error."""
    return spark.read.schema(schema).options(mode="FAILFAST", **TIME_FORMATS).json(path).select(*[F.col(n) for n in schema.names])
