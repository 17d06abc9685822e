"""Latest row per key, load counts and the upsert of a patch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Counted text keys of about 100 bytes in a broadcast hash table: 100 MB.
MAX_BROADCAST_KEYS = 1_000_000


def keep_latest(rows: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``newest_first`` order.

    ``row_number() <= 1`` lets Spark drop all but one row per key and task before the shuffle,
    so a key with very many copies reaches its group as at most one row per task.
    """
    order = Window.partitionBy(key).orderBy(*newest_first)
    return (
        rows.withColumn("_age", F.row_number().over(order)).where(F.col("_age") <= 1).drop("_age")
    )


def load_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys in one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("distinct_keys")
    )


def upsert(
    base: DataFrame, patch: DataFrame, key: str, patch_rows: int | None = None
) -> DataFrame:
    """``patch`` rows replace ``base`` rows with the same key (nulls included) or are added.

    Both sides hold each key once. Only the patch's keys take part in the join. With a known,
    moderate number of them (``patch_rows``) they are broadcast and the base is not shuffled;
    otherwise Spark decides by its own size estimates.
    """
    keys = patch.select(key)
    if patch_rows is not None and patch_rows <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    kept = base.join(keys, key, "left_anti").select(*patch.columns)
    return kept.unionByName(patch)
