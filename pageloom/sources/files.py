"""Files of a store, by Hadoop's own interface, so that any path Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; none if it is not there."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(where))


def remove(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return bool(files.delete(where, True))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """A new small file; False if there is one of that name, which then stays."""
    files, where = _at(spark, path)
    try:
        out = files.create(where, False)
    except Exception as error:  # the file system's own kind of error
        if files.exists(where):
            return False
        raise error
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
