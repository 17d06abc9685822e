"""Rows of numeric arrays as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(column: str) -> Column:
    """Whether a vector is not null and holds only finite numbers."""
    infinite = float("inf")
    good = lambda x: (
        x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != infinite)
    )
    return F.col(column).isNotNull() & F.coalesce(F.forall(column, good), F.lit(False))


def one_per_id(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (id, vec), one per id; of several vectors with one id the smallest finite array counts.

    An id without a finite vector keeps its row, with a null.
    """
    return (
        rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"))
        .withColumn("vec", F.when(is_finite("vec"), F.col("vec")))
        .groupBy("id")
        .agg(F.min("vec").alias("vec"))
    )


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Equally long lists without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
