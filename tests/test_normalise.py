"""Loosely typed records, one by one, with values worked out by hand."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starscan.functions.counts import NO_COUNTS, canonical_json, histogram, merged_histogram, parse_counts
from starscan.operators import rollup
from starscan.operators.rollup import roll_up_rows
from starscan.plans.ingest import system_rows, utc_now
from starscan.sources.dump import parse_records

RINGS = [{"type": "Icy"}, 3]
QUIRKY_BODIES = [
    7,
    {"type": "Planet", "subType": "Water world", "rings": RINGS},
    {"subtype": "water world"},
    {"type": "Star", "rings": ["r"]},
]


def rows(spark, *records):
    lines = spark.createDataFrame(
        [(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)],
        "i int, value string",
    )
    parsed = lines.selectExpr("i", f"explode({parse_records('value')}) AS record", "'f' source_tag")
    result = system_rows(parsed, utc_now()).orderBy("i").collect()
    return [r.asDict() for r in result]


def one(spark, record):
    return rows(spark, record)[0]


CASES = [
    ({"id64": 1, "name": "A", "coords": {"x": 1, "y": 2, "z": 3}},
     {"system_key": "addr:1", "name": "A", "x": 1.0, "z": 3.0, "faction_count": 0,
      "total_bodies": 0, "body_type_counts": {}, "ring_type_counts": {}}),
    ({"name": "B", "x": 1, "y": 2, "z": -0.03125},
     {"system_key": "coords:b|1.00000000|2.00000000|-0.03125000"}),
    ({"name": "C"}, {"system_key": "name:c", "x": None, "y": None, "z": None}),
    ({"system_name": "D", "id64": "bad", "systemAddress": "9"},
     {"name": "D", "system_address": 9, "system_key": "addr:9"}),
    ({"id64": 5}, {"name": None}),
    ({"name": "F", "coords": {"x": None, "y": 0, "z": 0}, "x": 7}, {"x": None, "y": 0.0}),
    ({"name": "G", "coords": {"y": 0, "z": 0}, "x": 7}, {"x": 7.0}),
    ({"name": "H", "controllingFaction": "F1",
      "factions": ["a", {"name": "b"}, {"faction": "a"}, None]},
     {"controlling_faction": "F1", "faction_count": 4}),
    ({"name": "I", "controllingFaction": {"faction": "F2"}, "factions": {"k": 1}},
     {"controlling_faction": "F2", "faction_count": 1}),
    ({"name": "J", "controllingFaction": {}, "controllingFactionName": "X"},
     {"controlling_faction": None, "faction_count": 0}),
    ({"name": "K", "controllingFactionName": "X"},
     {"controlling_faction": "X", "faction_count": 1}),
    ({"name": "L", "population": 1.9}, {"population": 1}),
    ({"name": "L", "population": "1.9"}, {"population": None}),
    ({"name": "L", "population": "7"}, {"population": 7}),
    ({"name": "L", "population": True}, {"population": 1}),
    ({"name": "L", "id64": 2**63 + 5}, {"system_address": None, "system_key": "name:l"}),
    ({"name": "M", "bodies": QUIRKY_BODIES},
     {"total_bodies": 3, "total_planets": 1, "total_stars": 1, "ringed_body_count": 2,
      "water_world_count": 1, "earthlike_world_count": 0,
      "body_type_counts": {"Planet": 1, "Star": 1, "Unknown": 1},
      "body_subtype_counts": {"Water world": 1, "water world": 1},
      "ring_type_counts": {"Icy": 1}}),
    ({"name": 0, "system_name": 12}, {"name": "12"}),
    ({"name": False, "system_name": []}, {"name": None}),
    ({"name": True}, {"name": "True"}),
    ({"name": "0"}, {"name": "0", "system_key": "name:0"}),
    ({"name": "N", "coords": [], "x": "1.5", "y": "no"}, {"x": 1.5, "y": None}),
    ({"name": "N", "controllingFaction": ""}, {"controlling_faction": "", "faction_count": 0}),
    ({"name": "N", "controllingFaction": {"name": "", "faction": "f"}},
     {"controlling_faction": "f"}),
    ({"name": "N", "factions": [True, 3, 3, "", [], {"name": 0, "faction": "z"}]},
     {"faction_count": 4}),
    ({"name": "N", "factions": "text", "controllingFaction": "c"}, {"faction_count": 1}),
    ({"name": "N", "bodies": {"k": {"type": "Star"}}}, {"total_bodies": 0}),
    ({"name": "N", "bodies": [{"type": 0, "subType": "", "subtype": "s", "rings": {"a": 1}},
                              {"type": 5, "rings": {}}, {"type": [], "rings": [{"ringType": "R"},
                              {"type": "", "ringType": None}]}, {"rings": "x"}, {"rings": 0}]},
     {"total_bodies": 5, "ringed_body_count": 3, "body_type_counts": {"Unknown": 4, "5": 1},
      "body_subtype_counts": {"s": 1}, "ring_type_counts": {"R": 1, "Unknown": 1}}),
    ({"name": "N", "bodies": [{"type": "planet"}, {"subType": "Earth-like world"}]},
     {"total_planets": 0, "earthlike_world_count": 1}),
    ('{"name": "first", "name": "second"}', {"name": "second"}),
]


@pytest.fixture(scope="module")
def all_rows(spark):
    return rows(spark, *[record for record, _ in CASES])


@pytest.mark.parametrize("number", range(len(CASES)))
def test_record(all_rows, number):
    expected = CASES[number][1]
    assert {key: all_rows[number][key] for key in expected} == expected


@pytest.mark.parametrize("line", ['{"name": "A"', '{"name": "A"} x', "7", '"text"', '{"a":1} {"b":2}'])
def test_malformed_line_stops(spark, line):
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        rows(spark, line)


def test_several_objects_on_a_line(spark):
    assert [r["name"] for r in rows(spark, ' [{"name":"a"}, {"name":"b"}],', "]", "[")] == ["a", "b"]


def test_canonical_json_is_sorted_and_spaced(spark):
    counts = {"b": 2, 'q"\\x': 1, "é": 3, "[z]": 4, "": 5, "a\tb": 6}
    df = spark.createDataFrame([(counts,), ({},)], "m map<string,int>")
    got = [r[0] for r in df.selectExpr(canonical_json("m")).collect()]
    assert got == [json.dumps(counts, ensure_ascii=False, sort_keys=True), "{}"]


@pytest.mark.parametrize("n, different", [(0, 1), (1, 1), (7, 3), (40_000, 10_000)])
def test_histograms_of_many_labels(spark, n, different):
    """By rows and merged from parts; the work grows with the bodies, not with bodies x labels."""
    labels = spark.range(n).selectExpr(f"concat('é', id * 7919 % {different}) AS l")
    one = labels.agg(F.collect_list("l").alias("l"))
    want = dict(Counter(f"é{i * 7919 % different}" for i in range(n)))
    assert one.selectExpr(f"{histogram('l')} AS h").first()["h"] == want
    parts = one.selectExpr("transform(concat(l, l), v -> struct(v AS type, 3L AS n)) AS p")
    merged = parts.selectExpr(f"{merged_histogram('p', 'type')} AS h").first()["h"]
    assert merged == {label: 6 * count for label, count in want.items()}


def test_lists_are_gathered_behind_the_last_shuffle(spark):
    """Labels travel as plain counted rows, not as a list from every task."""
    rows = [(1, "Planet", "Water world", "Icy"), (1, "Planet", None, None), (1, None, "x", "Icy"), (None, "Star", None, None)]
    bodies = spark.createDataFrame(rows * 3, "k long, type string, subtype string, ring string")
    rolled = roll_up_rows(bodies, "k")
    executed = rolled._jdf.queryExecution().executedPlan().toString()
    assert executed.rindex("partial_collect_list") < executed.index("Exchange")
    got = {r["k"]: r.asDict() for r in rolled.collect()}
    assert got[1]["total_bodies"] == 9 and got[1]["ringed_body_count"] == 6 and got[1]["water_world_count"] == 3
    assert got[1]["body_type_counts"] == {"Planet": 6} and got[1]["total_planets"] == 6
    assert got[1]["body_subtype_counts"] == {"Water world": 3, "x": 3} and got[1]["ring_type_counts"] == {"Icy": 6}
    assert got[None]["total_stars"] == 3 and got[None]["body_subtype_counts"] == {}


def test_counts_of_numbers_are_read_at_once(spark):
    """No lambda for maps of numbers; other values are null, one by one."""
    texts = {'{"b": 2, "a": "1"}': {"a": 1, "b": 2}, '{"a": 1, "b": [2]}': {"a": 1, "b": None}, '{"a": 1} {}': {}, "null": {}}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["c"] for r in frame.selectExpr("t", f"{parse_counts('t')} AS c").collect()}
    assert got == texts
    assert "map<string,int>" in parse_counts("t").replace(NO_COUNTS, "")


def test_only_odd_labels_are_asked_for_their_kind(spark, monkeypatch):
    """Texts tell the labels of plain bodies; the reading by kinds stays for the others."""
    plain = [7, {"type": "Star", "rings": ["r", {}]}, {"type": "", "subtype": "Icy body", "rings": None}, None]
    odd = [[{"type": 5}], [{"type": "true"}], [{"subType": False}], [{"rings": "x"}], [{"rings": [{"type": 0}]}]]
    want = rows(spark, *[{"name": "A", "bodies": bodies} for bodies in [plain, *odd]])
    assert want[0]["body_type_counts"] == {"Star": 1, "Unknown": 1} and want[0]["ring_type_counts"] == {"Unknown": 1}
    assert [r["ringed_body_count"] for r in want] == [1, 0, 0, 0, 1, 1]
    assert [r["body_type_counts"] for r in want[1:3]] == [{"5": 1}, {"true": 1}]

    typed = "array<struct<type:string,subtype:string,ringed:boolean,rings:array<string>>>"
    monkeypatch.setattr(rollup, "_loose_bodies", lambda bodies: f"CAST(raise_error('asked') AS {typed})")
    assert one(spark, {"name": "A", "bodies": plain})["body_type_counts"] == want[0]["body_type_counts"]
    for bodies in odd:
        with pytest.raises(Exception, match="asked"):
            rows(spark, {"name": "A", "bodies": bodies})


def test_what_stands_around_an_object(spark):
    afters = ["", ",", " ,", ", \t", "\r", "]", ",\ufeff"]
    lines = [before + '{"name": "é}"}' + after for before in ("", " ", "[", "\ufeff[ ") for after in afters]
    assert [r["name"] for r in rows(spark, *lines)] == ["é}"] * len(lines)
