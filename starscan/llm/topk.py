"""Exact top-k search by inner product of integer vectors, with pivot-table elimination.

Queries and candidates are dealt into blocks of a bounded number of rows, and every pair of a query
block and a candidate block is one task. There the distances of all vectors to many pivots are tabled.
The largest difference of two rows of the table is a lower bound of the distance of two vectors,
and so, as ``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2``, an upper bound of their score. A query takes
its candidates in the order of that bound and stops when the bound falls below its k-th score.
Each task returns its k best; the best of all tasks are the answer, exact by construction.

Defined results. Vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Repeated ids: one vector (the smallest array). Vectors score only with those of equal
length. Ties: smaller id first. Fewer than k candidates: all. Empty table: no row. Scores must fit in
64 bits; sums that exceed the exact range of double are computed in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starscan.llm.common import stage
from starscan.llm.vectors import is_finite, matrix, one_per_id

QUERY_ROWS = 4096
CANDIDATE_ROWS = 8192
PIVOTS = 24
#: Queries whose bounds are held at once.
QUERIES_AT_ONCE = 128

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, factor: float) -> DataFrame:
    """Rows (id, vec: array<long>) with ``floor(factor * x)`` of each component."""
    valid = one_per_id(rows, vec_id, embedding).where(is_finite("vec")).where("id is not null")
    scale = lambda x: F.floor(x.cast("double") * F.lit(float(factor)))
    return valid.select("id", F.transform("vec", scale).alias("vec"))


def scores(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; ``exact`` says that double precision holds them."""
    if exact:
        return (vectors @ query).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, id, score) of each query's k best, and how many scores were computed."""
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    exact = largest * max(1, vectors.shape[1]) < 2.0**53
    number = np.float64 if exact else np.int64
    queries, vectors = queries.astype(number), vectors.astype(number)
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    pivots = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]

    def table(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], axis=1)

    q_table, x_table = table(q), table(x)
    q_norm, x_norm = (q * q).sum(1), (x * x).sum(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    computed = 0
    for at in range(0, len(q), QUERIES_AT_ONCE):
        rows = slice(at, at + QUERIES_AT_ONCE)
        least = np.zeros((len(q[rows]), len(x)))
        for p in range(len(pivots)):
            np.maximum(least, np.abs(q_table[rows, p, None] - x_table[None, :, p]), out=least)
        # rounding of the tables can only loosen the bound
        norms = q_norm[rows, None] + x_norm[None, :]
        bounds = (norms - (least * (1 - 1e-9)) ** 2) / 2 + norms * 1e-9 + 1
        for i in range(len(bounds)):
            by_bound = np.argsort(-bounds[i], kind="stable")
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            done, step = 0, 4 * k
            while done < len(x) and (len(best) < k or bounds[i][by_bound[done]] >= best[-1]):
                part = by_bound[done : done + step]
                part = part[ids[part] != query_ids[at + i]]
                some = scores(vectors[part], queries[at + i], exact)
                computed += len(part)
                best_ids, best = np.append(best_ids, ids[part]), np.append(best, some)
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                done, step = done + step, min(4 * step, 4096)
            found.append((np.full(len(best), query_ids[at + i]), best_ids, best))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *(np.concatenate(c) for c in zip(*found, strict=True)), computed


def top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for rows (id, vec: array<long>) on both sides."""
    queries, candidates = stage(spark, queries, "queries"), stage(spark, candidates, "candidates")
    q_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    c_blocks = max(1, -(-candidates.count() // CANDIDATE_ROWS))

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return rows.select(
            F.size("vec").alias("width"),
            F.pmod(F.xxhash64("id"), F.lit(own_blocks)).alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)).cast("array<long>")).alias(other),
            "id",
            "vec",
        )

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[0].as_py()
        query_ids, ids, found, _ = search_block(
            left.column("id").to_numpy(),
            matrix(left.column("vec"), width),
            right.column("id").to_numpy(),
            matrix(right.column("vec"), width),
            k,
        ) if len(left) and len(right) else (*np.zeros((3, 0), np.int64), 0)
        return pa.Table.from_arrays([pa.array(query_ids), pa.array(ids), pa.array(found)], schema=FOUND)

    key = ["width", "q_block", "c_block"]
    found = (
        dealt(queries, "q_block", q_blocks, "c_block", c_blocks)
        .groupBy(*key)
        .cogroup(dealt(candidates, "c_block", c_blocks, "q_block", q_blocks).groupBy(*key))
        .applyInArrow(pair, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
