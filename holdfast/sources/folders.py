"""Single files and folders on whatever file system a path names, handled from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    return sorted(s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path))) if exists(spark, path) else []


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; False if there is one already, so the first of several writers wins."""
    try:
        out = _files(spark, path).create(_path(spark, path), False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or exists(spark, path):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Puts a file in the place of another by one rename: readers see the old or the new text, never a part."""
    jvm, aside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    create(spark, aside, text)
    files = _files(spark, path)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(_path(spark, aside)), files.makeQualified(_path(spark, path)), how)


def read(spark: SparkSession, path: str) -> str:
    """Text of a small file."""
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
