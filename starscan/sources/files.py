"""Small file-system helpers on Spark's own file system layer (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def glob(spark: SparkSession, pattern: str) -> list[str]:
    hadoop_path, fs = _path(spark, pattern)
    found = fs.globStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in found or [])


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    if any(mark in path for mark in "*?[{"):
        return False
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def inputs(spark: SparkSession, path: str) -> list[str]:
    """What a scan of ``path`` reads: a folder's entries, or the matches of a name or pattern.

    Like Spark's own listing it passes over names that start with ``_`` or ``.``.
    """
    pattern = f"{path.rstrip('/')}/*" if is_directory(spark, path) else path
    return [name for name in glob(spark, pattern) if base_name(name)[0] not in "_."]


def base_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def total_size(spark: SparkSession, paths: list[str]) -> int:
    total = 0
    for path in paths:
        hadoop_path, fs = _path(spark, path)
        total += fs.getContentSummary(hadoop_path).getLength()
    return total


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)
