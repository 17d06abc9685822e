"""Radius search around one or many reference systems."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.functions import geometry as G
from starscan.functions.text import literal
from starscan.operators.topk import top_k_per_group
from starscan.session import scratch_path

# --- fixed values: body filters by name ---
BODY_FILTERS = {
    "any": "true",
    "ww": "water_world_count > 0",
    "elw": "earthlike_world_count > 0",
    "ww_or_elw": "(water_world_count > 0 OR earthlike_world_count > 0)",
    "ww_and_elw": "(water_world_count > 0 AND earthlike_world_count > 0)",
}
CLAIMABLE = "(coalesce(controlling_faction, '') = '' AND coalesce(faction_count, 0) = 0)"
# --- end of fixed values ---

LOCATED = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"

# A reference list given on the driver takes part in the join as 27 cells of about 100 bytes
# per reference. Up to this many (under 30 MB) it is broadcast; beyond, Spark decides by size.
MAX_BROADCAST_REFERENCES = 10_000
# The scan is pruned by as many boxes; references that lie close share one.
MAX_BOXES = 32

# Nearest first by rounded distance, then most bodies, then name; nulls last throughout. The
# key makes the order total.
RESULT_ORDER = [
    ("distance_ly", F.asc_nulls_last),
    ("total_bodies", F.desc_nulls_last),
    ("name", F.asc_nulls_last),
    ("system_key", F.asc),
]


def result_order() -> list[Column]:
    return [direction(name) for name, direction in RESULT_ORDER]


def row_filter(body_filter: str, claimable_only: bool = False) -> str:
    chosen = body_filter.lower()
    if chosen not in BODY_FILTERS:
        raise ValueError(f"body_filter must be one of: {', '.join(BODY_FILTERS)}")
    return f"{BODY_FILTERS[chosen]} AND {CLAIMABLE if claimable_only else 'true'}"


def clean_references(references: Iterable[str]) -> list[str]:
    """Stripped, blanks dropped, each once in first-seen order."""
    return list(dict.fromkeys(r.strip() for r in references if r.strip()))


def _stars_by_name(systems: DataFrame) -> DataFrame:
    """Of systems, or of a catalogue's names, where a filter on the name reaches the scan."""
    name = "name_lower" if "name_lower" in systems.columns else "lower(name)"
    return systems.selectExpr(f"{name} AS _name", "struct(system_key, x, y, z) AS _star")


def locate(systems: DataFrame, references: DataFrame) -> DataFrame:
    """Coordinates (``rx``, ``ry``, ``rz``) for rows with a ``reference_system`` name.

    Names match regardless of case. Of several systems with the name the smallest key counts;
    it may lack coordinates, like the name may be unknown: both leave nulls.
    """
    wanted = references.withColumn("_name", F.lower("reference_system"))
    hits = (
        _stars_by_name(systems)
        .join(wanted.select("_name").distinct(), "_name", "left_semi")
        .groupBy("_name")
        .agg(F.min("_star").alias("_star"))
    )
    return wanted.join(hits, "_name", "left").selectExpr(
        *references.columns, *[f"_star.{axis} AS r{axis}" for axis in G.AXES]
    )


def reference_points(systems: DataFrame, references: Sequence[str]) -> list[tuple]:
    """(name, x, y, z) of each reference, looked up together in one column-pruned scan.

    ``systems`` may be a catalogue's ``names``. Raises when one is unknown or has no coordinates.
    """
    names = sorted({name.lower() for name in references})
    located = (
        _stars_by_name(systems)
        .where(F.col("_name").isin(names))
        .groupBy("_name")
        .agg(F.min("_star").alias("_star"))
    )
    found = {row["_name"]: row["_star"] for row in located.collect()}
    points = []
    for name in references:
        star = found.get(name.lower())
        if star is None or any(star[axis] is None for axis in G.AXES):
            raise ValueError(f"reference system unknown or without coordinates: {name}")
        points.append((name, *(float(star[axis]) for axis in G.AXES)))
    return points


def within_radius(
    systems: DataFrame, reference: str, origin: Sequence[float], radius: float
) -> DataFrame:
    """Systems in the ball around one point, without namesakes of the reference.

    ``distance_ly`` is rounded for display; the radius test uses the exact distance.
    """
    exact = G.distance(G.AXES, [G.number(value) for value in origin])
    near = (
        f"{G.around([origin], radius)} AND {exact} <= {G.number(radius)}"
        if G.is_searchable(radius)
        else "false"
    )
    return systems.where(
        f"{near} AND lower(name) <> lower({literal(reference)})"
    ).selectExpr("*", f"{G.round2(exact)} AS distance_ly")


def search_one(
    systems: DataFrame,
    reference: str,
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """Ordered top ``limit`` around one reference, numbered in ``rank``. ``points`` spares the
    look-up if its ``reference_points`` are known."""
    keep = row_filter(body_filter, claimable_only)
    ((_, *origin),) = points or reference_points(systems, [reference])
    return (
        within_radius(systems, reference, origin, radius)
        .where(keep)
        .selectExpr(
            "*",
            "1 AS ref_ord",
            f"{literal(reference)} AS reference_system",
            f"{CLAIMABLE} AS claimable",
        )
        .orderBy(*result_order())
        .limit(limit)
        # the limited rows are one ordered partition, so their ids are consecutive
        .selectExpr("*", "int(monotonically_increasing_id() + 1) AS rank")
    )


def reference_table(spark: SparkSession, points: Sequence[tuple]) -> DataFrame:
    """(ref_ord, reference_system, rx, ry, rz) from (name, x, y, z), numbered from 1."""
    names, *axes = zip(*points) if points else ((), (), (), ())
    columns = {
        "ref_ord": pa.array(range(1, len(names) + 1), pa.int32()),
        "reference_system": pa.array(names, pa.string()),
    }
    columns |= {f"r{axis}": pa.array(values, pa.float64()) for axis, values in zip(G.AXES, axes)}
    return spark.createDataFrame(pa.table(columns))


def unlocated(references: DataFrame) -> DataFrame:
    """The located references (``locate``) that are unknown or without coordinates."""
    return references.where("rx IS NULL OR ry IS NULL OR rz IS NULL")


def require_located(references: DataFrame) -> None:
    """Raises with the number and the first names of references that are unknown."""
    row = (
        unlocated(references)
        .groupBy()
        .agg(F.count("*").alias("n"), F.min("reference_system").alias("first"))
        .first()
    )
    if row["n"]:
        raise ValueError(
            f"reference system unknown or without coordinates: {row['first']} and {row['n'] - 1} more"
        )


def largest_of(references: DataFrame) -> float:
    """The largest absolute coordinate of the references."""
    sizes = [F.max(F.abs(f"r{axis}")) for axis in G.AXES]
    return max((value for value in references.agg(*sizes).first() if value is not None), default=0.0)


def radius_join(
    points: DataFrame, references: DataFrame, radius: float, largest_coordinate: float | None = None
) -> DataFrame:
    """All (point, reference) pairs within ``radius``, as an equi-join on grid cells.

    ``references`` has ``rx``, ``ry``, ``rz``; ``largest_coordinate``, their largest absolute
    value, is looked up if it is not given. Each reference is listed under its cell and the 26 around it, so a point meets only
    references in reach of its own cell, and the exact distance decides. A crowded cell makes a
    skewed join key: when the references are too large to broadcast, adaptive execution splits
    its points over several tasks.
    """
    if largest_coordinate is None:
        largest_coordinate = largest_of(references)
    edge = G.cell_size(radius, largest_coordinate) if G.is_searchable(radius) else 1.0
    reach = G.number(radius) if G.is_searchable(radius) else "-1D"
    listed = references.where("rx IS NOT NULL AND ry IS NOT NULL AND rz IS NOT NULL").selectExpr(
        "*", f"inline({G.neighbour_cells(G.REF_AXES, edge)})"
    )
    placed = points.where(LOCATED).selectExpr(
        "*", *[f"{place} AS c{axis}" for axis, place in zip(G.AXES, G.cell(G.AXES, edge))]
    )
    return (
        placed.join(listed, ["cx", "cy", "cz"])
        .withColumn("distance", F.expr(G.distance(G.AXES, G.REF_AXES)))
        .where(f"distance <= {reach}")
        .drop("cx", "cy", "cz")
    )


def search_around(
    systems: DataFrame,
    references: DataFrame,
    radius: float,
    largest_coordinate: float | None = None,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    skip_unknown: bool = False,
) -> DataFrame:
    """Top ``limit`` per row of ``references`` (``ref_ord``, ``reference_system``, rx, ry, rz),
    numbered in ``rank``. Each reference has its own radius, order and limit.

    A reference without coordinates stops the search unless ``skip_unknown``. Only what ranking
    needs goes through the cell join and the ranking; the rest of a hit is joined to it by key.
    """
    if not skip_unknown:
        require_located(references)
    candidates = systems.where(row_filter(body_filter, claimable_only))
    narrow = candidates.select("system_key", "name", "total_bodies", *G.AXES)
    hits = (
        radius_join(narrow, references, radius, largest_coordinate)
        .where("lower(name) <> lower(reference_system)")
        .selectExpr("*", f"{G.round2('distance')} AS distance_ly")
        .drop("distance", *G.AXES, *G.REF_AXES)
    )
    best = top_k_per_group(hits, ["ref_ord"], result_order(), limit).drop("name", "total_bodies")
    return candidates.selectExpr("*", f"{CLAIMABLE} AS claimable").join(best, "system_key")


def rank_pairs(
    systems: DataFrame,
    pairs: DataFrame,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
) -> DataFrame:
    """Top ``limit`` per reference of pairs that are known already.

    ``pairs`` has ``ref_ord``, ``reference_system``, ``system_key`` and ``distance``. Rows of those
    columns but the last, with ``distance_ly``, ``name``, ``total_bodies`` and ``rank``.
    """
    candidates = systems.where(row_filter(body_filter, claimable_only))
    hits = (
        pairs.join(candidates.select("system_key", "name", "total_bodies"), "system_key")
        .where("lower(name) <> lower(reference_system)")
        .withColumn("distance_ly", F.expr(G.round2("distance")))
        .drop("distance")
    )
    return top_k_per_group(hits, ["ref_ord"], result_order(), limit)


def search_many(
    systems: DataFrame,
    references: Iterable[str],
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """``search_around`` for a list of names; any unknown name stops the whole search.
    ``points`` spares the look-up if their ``reference_points`` are known."""
    if points is None:
        names = clean_references(references)
        if len(names) > MAX_BROADCAST_REFERENCES:
            return _search_table(
                systems, names, radius, body_filter=body_filter, claimable_only=claimable_only, limit=limit
            )
        points = reference_points(systems, names)
    table = reference_table(systems.sparkSession, points)
    if len(points) <= MAX_BROADCAST_REFERENCES:
        table = F.broadcast(table)
    largest = max((abs(value) for _, *origin in points for value in origin), default=0.0)
    return search_around(
        systems.where(reach([origin for _, *origin in points], radius)),
        table,
        radius,
        largest,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
    )


def _search_table(systems: DataFrame, names: list[str], radius: float, **options) -> DataFrame:
    """``search_many`` for a long list: it becomes a table, and so does what the look-up finds."""
    spark = systems.sparkSession
    listed = pa.table(
        {
            "ref_ord": pa.array(range(1, len(names) + 1), pa.int32()),
            "reference_system": pa.array(names, pa.string()),
        }
    )
    path = scratch_path(spark, "references")
    locate(systems, spark.createDataFrame(listed)).write.parquet(path)
    return search_around(systems, spark.read.parquet(path), radius, **options)


def reach(origins: Sequence[Sequence[float]], radius: float) -> str:
    """A scan-level predicate no hit can fail: boxes around the references, at most ``MAX_BOXES``."""
    if not origins or not G.is_searchable(radius):
        return "false"
    return " OR ".join(f"({G.around(group, radius)})" for group in clusters(origins, MAX_BOXES))


def clusters(origins: Sequence[Sequence[float]], most: int) -> list[list[Sequence[float]]]:
    """Points in at most ``most`` groups, made by cutting the widest group at its widest gap."""
    groups, done = [list(origins)], []

    def widest(group: list[Sequence[float]]) -> tuple[float, int]:
        return max((max(p[a] for p in group) - min(p[a] for p in group), a) for a in range(len(G.AXES)))

    while groups and len(groups) + len(done) < most:
        groups.sort(key=widest)
        group = groups.pop()
        extent, axis = widest(group)
        if not extent:
            done.append(group)
            continue
        group.sort(key=lambda point: point[axis])
        gaps = [b[axis] - a[axis] for a, b in zip(group, group[1:])]
        cut = gaps.index(max(gaps)) + 1
        groups += [group[:cut], group[cut:]]
    return groups + done
