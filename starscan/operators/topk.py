"""Best k rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starscan.session import scratch_path

MERGE_WIDTH = 64
# A group's best so many, of each slice, fit one task.
MAX_TASK_ROWS = 250_000


def top_k_per_group(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in ``rank``.

    Every task keeps its own best k before anything is shuffled. Those are merged in two steps,
    first by slices of the producing tasks, so that a group with hits in very many tasks is not
    merged by a single one. ``order`` must be total for a repeatable result. Beyond
    ``MAX_TASK_ROWS`` no task sorts a whole group (``_top_k_by_range``).
    """
    if k > MAX_TASK_ROWS:
        return _top_k_by_range(rows, group, order, k, rank)
    sliced = rows.withColumn("_slice", F.spark_partition_id() % MERGE_WIDTH)
    by_slice = Window.partitionBy(*group, "_slice").orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    return (
        sliced.withColumn(rank, F.row_number().over(by_slice))
        .where(F.col(rank) <= k)
        .drop("_slice", rank)
        .withColumn(rank, F.row_number().over(by_group))
        .where(F.col(rank) <= k)
    )


def _top_k_by_range(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str
) -> DataFrame:
    """``top_k_per_group`` for any ``k``: rows are sorted by ranges over all tasks, and a row's number
    is its place in its range plus the rows of the group in earlier ranges."""
    spark = rows.sparkSession
    unsorted, ranged = scratch_path(spark, "unranked"), scratch_path(spark, "ranged")
    # written out so that the sampling of the ranges does not make the rows once more
    rows.write.parquet(unsorted)
    written = spark.read.schema(rows.schema).parquet(unsorted)
    # range numbers are made once, or a second sampling could draw other borders
    written.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).write.parquet(ranged)
    placed = spark.read.parquet(ranged)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each group and range
    offsets = (
        placed.groupBy(*group, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where(F.col("_before") < k)
        .selectExpr("_range AS _of_range", "_before", *[f"`{name}` AS `_of_{name}`" for name in group])
    )
    same = F.col("_range") == F.col("_of_range")
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    in_range = Window.partitionBy(*group, "_range").orderBy(*order)
    return (
        placed.join(offsets, same)
        .withColumn(rank, (F.row_number().over(in_range) + F.col("_before")).cast("int"))
        .where(F.col(rank) <= k)
        .select(*rows.columns, rank)
    )
