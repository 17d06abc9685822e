"""Helpers shared by the operators: staged tables, hot-key joins, columnar batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.session import scratch_path

#: Bytes of text that a task handles at once, whatever the size of Spark's batches.
CHUNK_BYTES = 4 << 20
#: A key with more than this share of all rows is hot; so there are at most ``1 / HOT_SHARE``.
HOT_SHARE = 0.001


def stage(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """The frame written below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage: what follows neither repeats the work nor depends on the executors that did it.
    """
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, where ``right`` has one row per key.

    ``right[count]`` says how many rows of ``left`` have the key. Keys of more than ``HOT_SHARE``
    of all rows, at most a thousand, are sent to every task; the others meet in a shuffle in which
    no key is large. ``left`` is read twice and should be a staged table.
    """
    total = right.agg(F.sum(count)).head()[0] or 0
    is_hot = F.col(count) > F.lit(max(1000, int(total * HOT_SHARE)))
    values = [c for c in right.columns if c != count]
    hot = right.where(is_hot).select(*values)
    cold = right.where(~is_hot).select(*values)
    if hot.isEmpty():
        return left.join(cold, key, "left")
    return left.join(F.broadcast(hot), key, "inner").unionByName(
        left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    )


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``size`` bytes of text, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    # a worker lives on for other tasks
    pa.default_memory_pool().release_unused()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])``."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the links ``left[i] - right[i]``."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b: long): rows (node, root), root the smallest node.

    Every node that has a link gets a row. Alternates the two star contractions (all larger
    neighbours move to the smallest neighbour; the others follow), so that the rounds grow with the
    logarithm of the graph. A hub is never gathered: its minimum is a pre-aggregated ``min`` and its
    neighbours are joined back with ``lookup``. Each round is a written table.
    """
    edges = stage(
        spark,
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct(),
        "links",
    )
    while True:
        both = stage(
            spark, edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both"
        )
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = stage(
            spark,
            lookup(both, stage(spark, least, "least"), "a", "n")
            .where("b > a")
            .select(F.col("m").alias("a"), "b")
            .distinct(),
            "large",
        )
        # each node b looks at its smaller neighbours a only
        least = large.groupBy(F.col("b")).agg(F.min("a").alias("m"), F.count("*").alias("n"))
        met = lookup(large, stage(spark, least, "least"), "b", "n")
        small = stage(
            spark,
            met.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(met.select(F.col("m").alias("a"), "b"))
            .where("a < b")
            .distinct(),
            "small",
        )
        # done when every node has one smaller neighbour and that one has none
        tops = small.select(F.col("a").alias("b")).distinct()
        if small.join(tops, "b", "left_semi").isEmpty() and (
            small.count() == small.select("b").distinct().count()
        ):
            return small.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                tops.select(F.col("b").alias("node"), F.col("b").alias("root"))
            )
        edges = small
