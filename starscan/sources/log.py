"""Append-only logs of small entries as Parquet files, few however long the log is.

Entries go to the newest generation, a folder. When that holds ``MOST_FILES`` files, all of it is
written as one file of the next generation, and the generation before is deleted. A generation counts
once its writer has finished, and one that readers may have listed stays for another
``MOST_FILES`` appends. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from starscan.sources import files

MOST_FILES = 32


def _generations(spark: SparkSession, path: str) -> list[str]:
    """The folders of finished generations, oldest first."""
    return [found.removesuffix("/_SUCCESS") for found in files.glob(spark, f"{path}/generation-*/_SUCCESS")]


def _folder(path: str, number: int) -> str:
    return f"{path}/generation-{number:09d}"


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All entries so far."""
    found = _generations(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found[-1])


def append(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Adds a few entries as one file."""
    found = _generations(spark, path)
    newest = found[-1] if found else _folder(path, 0)
    entries.coalesce(1).write.mode("append").parquet(newest)
    if len(files.glob(spark, f"{newest}/*.parquet")) >= MOST_FILES:
        number = int(newest.rpartition("-")[2])
        whole = spark.read.schema(entries.schema).parquet(newest)
        # an attempt that has died is written anew
        whole.coalesce(1).write.mode("overwrite").parquet(_folder(path, number + 1))
        for old in found[:-1]:
            files.delete(spark, old)
