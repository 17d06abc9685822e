"""The counted octree and the best-first search against plain loops and the grid join."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_search import SCHEMA, make_systems

from starscan.functions.geometry import AXES, cell
from starscan.operators import nearest, octree
from starscan.operators import search as S


def crowded_points(seed=1):
    """Half of the points in a thousandth of the space, some in one place, some far out."""
    rng = random.Random(seed)
    places = [[rng.choice([rng.randint(-40, 40) / 4, rng.uniform(-10, 10)]) for _ in AXES] for _ in range(200)]
    places += [[rng.uniform(1, 1.2) for _ in AXES] for _ in range(200)]
    places += [[1.0, 1.0, 1.0]] * 80 + [[1e5, 0.0, 0.0], [-3.0, 1e4, 7.0]]
    return [(i, *place) for i, place in enumerate(places)]


def pairs_by_hand(points, references, radius):
    return sorted(
        (p[0], r[0]) for p in points for r in references
        if math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[1:], r[1:]))) <= radius
    )


@pytest.mark.parametrize("radius", [0.0, 0.05, 0.6, 30.0, -1.0, math.nan])
def test_every_pair_of_a_crowd(spark, radius):
    points = crowded_points()
    rng = random.Random(2)
    references = [(f"r{i}", *rng.choice(points)[1:]) for i in range(15)]
    references += [("outside", 1e6, 0.0, 0.0), ("beside", 10.1, 0.0, 0.0), ("unplaced", None, 0.0, 0.0)]
    left = spark.createDataFrame([*points, (-1, None, 0.0, 0.0)], "id int, x double, y double, z double")
    right = spark.createDataFrame(references, "reference_system string, rx double, ry double, rz double")
    got = octree.radius_join(left, right, radius, leaf_points=16)
    assert got.columns == ["id", *AXES, "reference_system", "rx", "ry", "rz", "distance"]
    found = sorted((r["id"], r["reference_system"]) for r in got.collect())
    assert found == pairs_by_hand(points, references[:-1], radius)


def test_points_that_coincide_are_compared_once(spark, monkeypatch):
    """Lists of at most ``TOGETHER`` rows meet, not rows; equal rows, nulls and signs of zeros come out as they are."""
    monkeypatch.setattr(octree, "TOGETHER", 8)
    places = [(0.0, 1.0, 2.0), (-0.0, 1.0, 2.0), (0.5, 1.0, 2.0), (9.0, 9.0, 9.0)]
    points = [(i % 7 or None, *places[i % 4]) for i in range(400)]
    references = [(f"r{i % 3}" if i % 5 else None, *places[i % 3]) for i in range(30)]
    left = spark.createDataFrame(points, "id int, x double, y double, z double")
    right = spark.createDataFrame(references, "reference_system string, rx double, ry double, rz double")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def halved(distance):
        asked.add(1)
        return distance / 2

    spark.udf.register("halved_distance", halved)
    got = octree.radius_join(left, right, 0.6, leaf_points=64, measure="halved_distance(distance)").collect()
    want = [(*p, *r, math.dist(p[1:], r[1:]) / 2) for p in points for r in references if math.dist(p[1:], r[1:]) <= 0.6]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == 9000
    # 200 + 100 points near are 25 + 13 lists, 20 + 10 references 3 + 2; rows would make 9000 pairs
    assert asked.value == (25 + 13) * (3 + 2)


def test_no_points(spark):
    none = spark.createDataFrame([], "id int, x double, y double, z double")
    references = S.reference_table(spark, [("r", 0.0, 0.0, 0.0)])
    assert octree.radius_join(none, references, 5.0).count() == 0


def test_half_of_all_points_in_one_cell(spark):
    """No task has twice the points of the median task; by grid cells one has half of all."""
    points = spark.range(60_000).selectExpr(
        "id", *[f"pmod(xxhash64(id, {i}), 100000) / CASE WHEN id % 2 = 0 THEN 1e3D ELSE 10D END AS {a}"
                for i, a in enumerate(AXES)])
    radius = 200.0

    def sizes(rows, *keys):
        dealt = rows.repartition(16, *keys).groupBy(F.spark_partition_id()).count()
        return sorted(r["count"] for r in dealt.collect())

    grid = points.selectExpr("*", *[f"{place} AS c{a}" for a, place in zip(AXES, cell(AXES, radius))])
    by_cell = sizes(grid, "cx", "cy", "cz")
    assert by_cell[-1] > 30_000
    tree = octree.build(points, radius, leaf_points=64)
    by_leaf = sizes(octree.place_points(tree, points), "leaf", "pile")
    assert len(by_leaf) == 16 and by_leaf[-1] < 2 * by_leaf[8]


def test_a_pile_is_dealt_out(spark):
    points = spark.range(5000).selectExpr("id", "1D AS x", "2D AS y", "3D AS z")
    tree = octree.build(points, 1.0, leaf_points=100)
    assert len(tree.crowded) == 0
    piles = octree.place_points(tree, points).groupBy("leaf", "pile").count().collect()
    assert len(piles) == 50 and max(r["count"] for r in piles) < 200
    references = S.reference_table(spark, [("a", 1.0, 2.0, 3.0), ("b", 1.0, 2.0, 4.5)])
    assert octree.radius_join(points, references, 1.0, leaf_points=100).count() == 5000


@pytest.mark.parametrize("limit, radius", [(200, 30.0), (7, 30.0), (1, 5.0), (20, 0.0), (3, -1.0)])
def test_best_first_equals_the_radius_join(spark, limit, radius):
    rows = make_systems(1500) + [
        (f"c{i:05}", f"Crowd {i}", *(1 + (i * p % 1009) / 4000 for p in (1, 17, 311)), i % 5, 1, 1, None, 0)
        for i in range(1500)
    ]
    systems = spark.createDataFrame(rows, SCHEMA)
    rng = random.Random(3)
    points = [(r[1], *r[2:5]) for r in rng.sample(rows, 12) if None not in r[2:5]]
    references = S.reference_table(spark, [*points, ("outside", 40.0, 0.0, 0.0)])
    want = S.search_around(systems, references, radius, body_filter="any", limit=limit)
    got = nearest.search_nearest(
        systems, references, radius, body_filter="any", limit=limit, leaf_points=32
    )
    shown = ["ref_ord", "reference_system", "rank", "system_key", "distance_ly", "claimable"]
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))


def test_best_first_makes_fewer_pairs(spark):
    points = spark.range(20_000).selectExpr(
        "concat('k', id) AS system_key", "concat('n', id) AS name", "1 AS total_bodies",
        *[f"pmod(xxhash64(id, {i}), 100000) / 5e3D AS {a}" for i, a in enumerate(AXES)])
    references = S.reference_table(spark, [(f"r{i}", *[float(i % 7 + 5)] * 3) for i in range(20)])
    all_pairs = S.radius_join(points, references, 9.0).count()
    found = nearest.best_first(points, references, 9.0, limit=200, leaf_points=64)
    assert found.rows.count() == 20 * 200
    assert found.pairs < all_pairs / 3 and found.rounds > 1


def test_unknown_references(spark):
    systems = spark.createDataFrame(make_systems(30), SCHEMA)
    wanted = spark.createDataFrame([(1, "nowhere at all"), (2, "Star 1")], "ref_ord int, reference_system string")
    located = S.locate(systems, wanted)
    with pytest.raises(ValueError, match="nowhere"):
        nearest.search_nearest(systems, located, 5.0)
    found = nearest.search_nearest(systems, located, 5.0, body_filter="any", skip_unknown=True)
    assert {r["ref_ord"] for r in found.collect()} <= {2}
