"""Names and small files in any store that Spark's file systems reach: listing, one-step creation, removal.

Only names and single small files pass here; tables are read and written by Spark.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    if not exists(spark, path):
        return []
    return [status.getPath().getName() for status in _system(spark, path).listStatus(_path(spark, path))]


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; False if it was not there."""
    return _system(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text in one step; False, and no change, if there is one already.

    The text is written beside the folder under a name that readers skip, and then renamed; the rename refuses an existing target.
    """
    jvm, system, target = spark.sparkContext._jvm, _system(spark, path), _path(spark, path)
    draft = _path(spark, f"{target.getParent().getParent()}/_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.mkdirs(target.getParent())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
        return True
    except Py4JJavaError as error:
        system.delete(draft, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
