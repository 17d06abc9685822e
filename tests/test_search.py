"""Radius search against plain Python loops."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starscan.functions.geometry import round2
from starscan.operators import nearest, topk
from starscan.operators import search as S
from starscan.operators.latest import keep_latest, upsert
from starscan.operators.search import (
    clean_references,
    locate,
    radius_join,
    reference_points,
    reference_table,
    search_many,
    search_one,
)
from starscan.operators.topk import top_k_per_group
from starscan.session import settings

SCHEMA = """system_key string, name string, x double, y double, z double, total_bodies int,
    water_world_count int, earthlike_world_count int, controlling_faction string, faction_count int"""


def make_systems(n=400, seed=1, spread=40):
    rng = random.Random(seed)

    def place():
        return rng.choice([rng.randint(-spread, spread) / 4, rng.uniform(-spread, spread) / 4])

    rows = [
        (f"k{i:04}", f"Star {i}", place(), place(), place(), rng.choice([None, 1, 2]),
         rng.choice([0, 1]), rng.choice([None, 0, 1]), rng.choice([None, "", "F"]),
         rng.choice([None, 0, 1]))
        for i in range(n)
    ]
    # a hot spot, a namesake, and systems without coordinates
    rows += [(f"h{i:04}", f"Hot {i}", 1.0, 1.0, 1.0, i % 3, 1, 1, None, 0) for i in range(200)]
    rows += [("z1", "STAR 1", 0.5, 0.5, 0.5, 1, 1, 1, None, 0)]
    rows += [("n1", "Nowhere", None, 1.0, 1.0, 1, 1, 1, None, 0)]
    return rows


@pytest.fixture(scope="module")
def systems(spark):
    return spark.createDataFrame(make_systems(), SCHEMA).repartition(4).cache()


def expected(rows, reference, radius, keep=lambda r: True, limit=200):
    origin = min(r for r in rows if r[1].lower() == reference.lower())[2:5]
    hits = []
    for r in rows:
        if None in r[2:5] or r[1].lower() == reference.lower() or not keep(r):
            continue
        d = math.sqrt(sum((a - b) ** 2 for a, b in zip(r[2:5], origin)))
        if d <= radius:
            hits.append((math.floor(d * 100 + 0.5) / 100, -(r[5] if r[5] is not None else -1),
                         r[1], r[0]))
    return [h[3] for h in sorted(hits)[:limit]]


def keys(df):
    return [r["system_key"] for r in df.select("system_key").collect()]


@pytest.mark.parametrize("radius", [0.0, 0.25, 3.0, 1000.0])
def test_one_reference(systems, radius):
    found = search_one(systems, "star 5", radius, body_filter="any", limit=150)
    got = keys(found)
    assert [r["rank"] for r in found.collect()] == list(range(1, len(got) + 1))
    assert got == expected(make_systems(), "star 5", radius, limit=150)


FILTERS = {
    "any": lambda r: True,
    "ww": lambda r: r[6] > 0,
    "elw": lambda r: (r[7] or 0) > 0,
    "ww_or_elw": lambda r: r[6] > 0 or (r[7] or 0) > 0,
    "WW_AND_ELW": lambda r: r[6] > 0 and (r[7] or 0) > 0,
}


@pytest.mark.parametrize("body_filter", FILTERS)
@pytest.mark.parametrize("claimable_only", [False, True])
def test_filters(systems, body_filter, claimable_only):
    def keep(r):
        unowned = not (r[8] or "") and not (r[9] or 0)
        return FILTERS[body_filter](r) and (unowned or not claimable_only)

    found = search_one(
        systems, "Star 9", 6.0, body_filter=body_filter, claimable_only=claimable_only
    )
    assert keys(found) == expected(make_systems(), "Star 9", 6.0, keep)
    assert not claimable_only or found.where("not claimable").count() == 0


@pytest.mark.parametrize("radius", [0.0, 0.3, 2.0, 7.5, 500.0])
def test_many_references_equal_single_searches(systems, radius):
    names = ["Star 3", " hot 7 ", "", "STAR 1", "Star 3", "Star 200"]
    found = search_many(systems, names, radius, body_filter="any", limit=30).collect()
    for number, name in enumerate(clean_references(names), start=1):
        rows = sorted((r for r in found if r["ref_ord"] == number), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r["reference_system"] for r in rows} <= {name}
        want = expected(make_systems(), name, radius, limit=30)
        assert [r["system_key"] for r in rows] == want


@pytest.mark.parametrize("seed", range(4))
def test_grid_join_finds_every_pair(spark, seed):
    rng = random.Random(seed)
    scale = rng.choice([0.01, 1.0, 1e6])
    radius = rng.choice([0.5, 1.0, 3.0]) * scale
    # whole multiples of the radius put points exactly on cell borders and at distance radius
    points = [(i, *(rng.choice([rng.randint(-4, 4) * radius, rng.uniform(-4, 4) * radius])
                    for _ in "xyz")) for i in range(150)]
    origins = [(f"r{i}", *rng.choice(points)[1:]) for i in range(12)]
    left = spark.createDataFrame(points, "id int, x double, y double, z double")
    got = radius_join(left, reference_table(spark, origins), radius, 5 * radius)
    pairs = sorted((r["id"], r["reference_system"]) for r in got.collect())
    want = sorted(
        (p[0], o[0]) for p in points for o in origins
        if math.sqrt(sum((a - b) * (a - b) for a, b in zip(p[1:], o[1:]))) <= radius
    )
    assert pairs == want


@pytest.mark.parametrize("radius", [-1.0, math.nan])
def test_impossible_radius_finds_nothing(systems, radius):
    assert search_one(systems, "Star 1", radius).count() == 0
    assert search_many(systems, ["Star 1"], radius).count() == 0


@pytest.mark.parametrize("name", ["No such", "Nowhere"])
def test_unknown_or_unplaced_reference(systems, name):
    with pytest.raises(ValueError, match=name):
        search_one(systems, name, 1.0)
    with pytest.raises(ValueError, match=name):
        search_many(systems, ["Star 1", name], 1.0)


def test_unknown_filter(systems):
    with pytest.raises(ValueError, match="body_filter"):
        search_one(systems, "Star 1", 1.0, body_filter="moons")


def test_quotes_and_backslashes_in_names(spark):
    rows = [("a", "O'Neil \\ \"x\"", 0.0, 0.0, 0.0, 1, 1, 1, None, 0),
            ("b", "near", 1.0, 0.0, 0.0, 1, 1, 1, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert keys(search_one(df, "o'neil \\ \"X\"", 2.0)) == ["b"]


def test_namesakes_smallest_key_counts(spark, systems):
    assert reference_points(systems, ["star 1"])[0][1:] == make_systems()[1][2:5]
    wanted = spark.createDataFrame([("star 1",), ("nowhere",), ("?",)], "reference_system string")
    got = {r["reference_system"]: r["rx"] for r in locate(systems, wanted).collect()}
    assert got == {"star 1": make_systems()[1][2], "nowhere": None, "?": None}


def test_box_reaches_the_parquet_scan(spark, systems, tmp_path):
    systems.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = search_one(spark.read.parquet(str(tmp_path / "t")), "Star 1", 2.0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x," in text and "LessThanOrEqual(z," in text


def test_many_references_use_a_hash_join(systems):
    plan = search_many(systems, ["Star 1", "Star 2"], 2.0)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_with_a_hot_group(spark):
    df = spark.range(20_000).repartition(16).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 50 END AS g", "id * 7919 % 20011 AS v", "id"
    )
    got = top_k_per_group(df, ["g"], [F.asc("v"), F.asc("id")], 5).collect()
    rows = {}
    for i in range(20_000):
        rows.setdefault(0 if i % 3 < 2 else i % 50, []).append((i * 7919 % 20011, i))
    want = {(g, rank, i) for g, vs in rows.items() for rank, (_, i) in enumerate(sorted(vs)[:5], 1)}
    assert {(r["g"], r["rank"], r["id"]) for r in got} == want


def test_keep_latest_prunes_before_the_shuffle(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 100 END AS k", "id")
    latest = keep_latest(df, "k", [F.desc("id")])
    assert latest.count() == df.select("k").distinct().count()
    assert latest.where("k = -1").first()["id"] == 8997
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_upsert_twice_is_upsert_once(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    patch = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    once = upsert(base, patch, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, upsert(once, patch, "k").collect())) == [(1, "a"), (2, None), (3, "c")]
    counted = upsert(base, patch, "k", patch_rows=2)
    assert sorted(map(tuple, counted.collect())) == [(1, "a"), (2, None), (3, "c")]
    assert "BroadcastHashJoin" in counted._jdf.queryExecution().executedPlan().toString()


def test_rounding_of_distances(spark):
    values = [1.005, 2.675, 0.285, 1.115, 0.125, 0.005, 12.344999999, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.selectExpr(round2("v")).collect()]
    assert got == [math.floor(v * 100 + 0.5) / 100 for v in values]


def test_unknown_references_stop_a_table_search(spark, systems):
    wanted = spark.createDataFrame([(1, "nowhere at all"), (2, "nor here")], "ref_ord int, reference_system string")
    located = S.locate(systems, wanted)
    assert S.unlocated(located).count() == 2
    with pytest.raises(ValueError, match="nor here and 1 more"):
        S.search_around(systems, located, 5.0)
    assert S.search_around(systems, located, 5.0, skip_unknown=True).count() == 0


def test_long_reference_lists_become_tables(spark, systems, monkeypatch):
    names = [r["name"] for r in systems.select("name").where(S.LOCATED).distinct().limit(4).collect()]
    want = S.search_many(systems, names, 9.0, body_filter="any", limit=3)
    monkeypatch.setattr(S, "MAX_BROADCAST_REFERENCES", 2)
    got = S.search_many(systems, names, 9.0, body_filter="any", limit=3)
    shown = ["ref_ord", "rank", "system_key", "distance_ly", "claimable"]
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))
    with pytest.raises(ValueError, match="unknown"):
        S.search_many(systems, [*names, "nowhere"], 9.0)


def test_far_references_keep_boxes_of_their_own():
    origins = [(float(i * 1000), 0.0, 0.0) for i in range(S.MAX_BOXES + 1)]
    groups = S.clusters(origins, S.MAX_BOXES)
    assert len(groups) == S.MAX_BOXES and sorted(p for g in groups for p in g) == origins
    assert max(max(p[0] for p in g) - min(p[0] for p in g) for g in groups) == 1000.0
    assert S.clusters([(1.0, 2.0, 3.0)] * 50, 32) == [[(1.0, 2.0, 3.0)] * 50]


def test_top_k_prunes_at_any_limit(spark, systems):
    top = S.search_around(systems, S.reference_table(spark, [("x", 0.0, 0.0, 0.0)]), 5.0, limit=200_000)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_coordinates_beyond_any_guess(spark):
    points = spark.createDataFrame([("a", 3e12, 0.0, 0.0)], "system_key string, x double, y double, z double")
    references = S.reference_table(spark, [("r", 3e12 + 1, 0.0, 0.0)])
    assert S.radius_join(points, references, 2.0).count() == 1


def test_top_k_of_a_large_limit_is_ranked_by_ranges(spark, monkeypatch):
    """One task sorted all rows of a group, here 5,000 of them."""
    monkeypatch.setattr(topk, "MAX_TASK_ROWS", 100)
    df = spark.range(12_000).repartition(8).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3 = 0 THEN null ELSE id % 5 END AS g",
        "CASE WHEN id % 7 > 0 THEN id % 50 END AS v",
        "id",
    )
    order = [F.desc_nulls_last("v"), F.asc("id")]
    window = Window.partitionBy("g").orderBy(*order)
    want = df.withColumn("rank", F.row_number().over(window)).where("rank <= 5000")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        top = top_k_per_group(df, ["g"], order, 5000)
        assert top.dtypes == want.dtypes
        assert sorted(map(str, top.collect())) == sorted(map(str, want.collect()))
        # the largest group is numbered in several tasks
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert "Window [row_number()" in plan and "_range" in plan
        tasks = top.where("g = 0").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1


def test_few_places_meet_few_pairs(spark):
    """The first shell was as wide as the leaf, however few places there were to fill."""
    points = spark.range(20_000).selectExpr(
        "string(id) AS system_key", "string(id) AS name", "1 AS total_bodies",
        *[f"pmod(xxhash64(id, {i}), 100003) / 10000D AS {axis}" for i, axis in enumerate("xyz")],
    )
    references = points.where("system_key % 100 = 0").selectExpr(
        "int(system_key) AS ref_ord", "name AS reference_system", "x AS rx", "y AS ry", "z AS rz"
    )
    found = nearest.best_first(points, references, 4.0, 5, leaf_points=64)
    near = S.radius_join(points, references, 4.0).where("name <> reference_system")
    ranked = near.selectExpr("*", "round(distance * 100) / 100 AS distance_ly")
    want = top_k_per_group(ranked, ["ref_ord"], S.result_order(), 5).select("ref_ord", "rank", "name")
    assert sorted(found.rows.select("ref_ord", "rank", "name").collect()) == sorted(want.collect())
    assert found.pairs < 200 * 600
