"""The best rows around many references without making every pair within the radius.

Each reference looks at the leaves of a counted octree in shells of growing distance: first those
within a part of the width of its own leaf, about as far as ``limit`` stars reach and small where stars
are crowded, then half as far again, and so on. It is finished when its last place is nearer than anything a next shell can hold, so that a
reference in a crowd meets some multiple of ``limit`` stars however many lie within its radius.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from starscan.functions import geometry as G
from starscan.operators import octree
from starscan.operators.search import (
    CLAIMABLE,
    require_located,
    result_order,
    row_filter,
    search_around,
)
from starscan.operators.topk import top_k_per_group
from starscan.session import scratch_path

#: How much farther the next shell reaches.
GROWTH = 1.5


class Nearest(NamedTuple):
    """Rows (ref_ord, reference_system, system_key, name, total_bodies, distance_ly, rank), and what they took."""

    rows: DataFrame
    pairs: int
    rounds: int


def _written(rows: DataFrame, label: str) -> DataFrame:
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def best_first(
    points: DataFrame, references: DataFrame, radius: float, limit: int, leaf_points: int = octree.LEAF_POINTS
) -> Nearest:
    """The first ``limit`` of ``points`` (system_key, name, total_bodies, x, y, z) per reference."""
    tree = octree.build(points, radius, leaf_points)
    placed = _written(octree.place_points(tree, points), "placed")
    own_leaf = octree.place_points(
        tree, references.selectExpr("ref_ord", *[f"r{axis} AS {axis}" for axis in G.AXES])
    )
    width = tree.node_edge(f"int(shiftright(leaf, {3 * octree.BITS}))")
    width = f"{width} * {G.number(min(1.0, (limit / tree.leaf_points) ** (1 / 3)))}"
    near = own_leaf.groupBy("ref_ord").agg(F.min(F.expr(f"least({G.number(radius)}, {width})")).alias("reach"))
    active = _written(references.join(near, "ref_ord").selectExpr("*", "-1D AS seen"), "active")
    best, finished, pairs, rounds = None, [], 0, 0
    while not active.isEmpty():
        counted = Observation()
        met = placed.join(octree.list_leaves(tree, active, "reach", beyond="seen"), ["leaf", "pile"])
        found = (
            met.observe(counted, F.count("*").alias("pairs"))
            .withColumn("distance", F.expr(G.distance(G.AXES, G.REF_AXES)))
            .where(f"distance <= {G.number(radius)} AND lower(name) <> lower(reference_system)")
            .selectExpr(
                "ref_ord", "reference_system", "system_key", "name", "total_bodies",
                f"{G.round2('distance')} AS distance_ly",
            )
        )
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best = _written(top_k_per_group(found, ["ref_ord"], result_order(), limit), "best")
        pairs += counted.get["pairs"]
        rounds += 1
        last = best.where(F.col("rank") == limit).selectExpr("ref_ord", "distance_ly AS last")
        # what has not been met lies farther than ``reach``, so its rounded distance is no smaller
        going_on = f"reach < {G.number(radius)} AND (last IS NULL OR last >= {G.round2('reach')})"
        active = _written(
            active.join(last, "ref_ord", "left")
            .where(going_on)
            .selectExpr(
                *references.columns,
                f"least({G.number(radius)}, reach * {GROWTH}D) AS reach",
                "reach AS seen",
            ),
            "active",
        )
        finished.append(best.join(active.select("ref_ord"), "ref_ord", "left_anti"))
        best = best.join(active.select("ref_ord"), "ref_ord", "left_semi")
    if not finished:
        nothing = references.selectExpr(
            "ref_ord", "reference_system", "'' AS system_key", "'' AS name", "0 AS total_bodies",
            "0D AS distance_ly", "0 AS rank",
        )
        return Nearest(nothing.limit(0), 0, 0)
    return Nearest(functools.reduce(DataFrame.unionByName, finished), pairs, rounds)


def search_nearest(
    systems: DataFrame,
    references: DataFrame,
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    skip_unknown: bool = False,
    leaf_points: int = octree.LEAF_POINTS,
) -> DataFrame:
    """``search.search_around``, best first. ``ref_ord`` is unique in ``references``."""
    options = {"body_filter": body_filter, "claimable_only": claimable_only, "limit": limit}
    if not G.is_searchable(radius) or limit < 1:
        return search_around(systems, references, radius, skip_unknown=skip_unknown, **options)
    if not skip_unknown:
        require_located(references)
    candidates = systems.where(row_filter(body_filter, claimable_only))
    narrow = candidates.select("system_key", "name", "total_bodies", *G.AXES)
    listed = references.select("ref_ord", "reference_system", *G.REF_AXES)
    best = best_first(narrow, listed, radius, limit, leaf_points).rows.drop("name", "total_bodies")
    return candidates.selectExpr("*", f"{CLAIMABLE} AS claimable").join(best, "system_key")
