"""Report formats against the Python standard library and a plain packing loop."""

import csv
import io
import json
import random
from urllib.parse import quote_plus

import pytest

from starscan.functions.counts import alias_sum, derived_counts, parse_counts
from starscan.functions.links import (
    DEFAULT_TEMPLATES,
    fill_template,
    link_columns,
    load_templates,
    merge_templates,
)
from starscan.functions.text import number_text, one_decimal, pad_left, query_escape
from starscan.operators import report
from starscan.operators.report import (
    CSV_HEADINGS,
    MESSAGE_CAP,
    TABLE_HEAD,
    TABLE_HEADER,
    complete_results,
    messages,
)
from starscan.sinks import write_csv, write_json

NASTY = ["S*A~é/b c", 'q"uo;te', "  lead", "trail ", "a\nb", "c\rd", "x" * 40, "😀 名", "'", "\\n\\"]


def column(spark, values, type_name, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]


def test_one_decimal_rounds_like_python(spark):
    rng = random.Random(2)
    values = [i / 100 for i in range(2000)] + [rng.uniform(0, 10**e) for e in range(9)
                                               for _ in range(300)]
    values += [0.25, 0.35, 0.05, 0.15, 99999.95, 9.95, 0.95, 1234567.25]
    values += [round(rng.uniform(0, 1000), 2) for _ in range(2000)]
    assert column(spark, values, "double", one_decimal("v")) == [f"{v:.1f}" for v in values]


def test_number_text(spark):
    values = [0.0, 0.01, 12.3, 9999999.99, 1e7, 12345678.25, 1.5e9]
    assert column(spark, values, "double", number_text("v")) == [str(v) for v in values]


def test_padding_never_cuts(spark):
    assert column(spark, ["7", "1234567"], "string", pad_left("v", 4)) == ["   7", "1234567"]


def test_query_escape(spark):
    values = NASTY + ["".join(map(chr, range(32, 127))), "%7E*"]
    assert column(spark, values, "string", query_escape("v")) == [quote_plus(v) for v in values]


def test_link_templates(spark, tmp_path):
    settings = tmp_path / "links.json"
    settings.write_text(json.dumps({
        "EDSM": "https://e/{name}", "inara": "  ", "edgis": "https://edgis.elitedangereuse.fr/",
        "other": "{name_path}", "bad": 5}))
    merged = load_templates(str(settings))
    assert merged == DEFAULT_TEMPLATES | {"edsm": "https://e/{name}", "other": "{name_path}"}
    assert load_templates(str(tmp_path / "missing.json")) == DEFAULT_TEMPLATES
    assert merge_templates([1]) == DEFAULT_TEMPLATES
    for template in ["{name}|{name_query}|{name_path}", "{{x}}{name}", "", "it's \\ {name}"]:
        want = [template.format(name=n, name_query=quote_plus(n), name_path=quote_plus(n))
                for n in NASTY]
        assert column(spark, NASTY, "string", fill_template(template, "v")) == want
    for broken in ["{unknown}", "{", "{}", "}"]:
        assert column(spark, ["n"], "string", fill_template(broken, "v")) == [broken]
    without = link_columns("v", merged, include_links=False)
    assert column(spark, ["a b"], "string", without["edsm_url"]) == [""]
    assert column(spark, ["a b"], "string", without["inara_url"]) == [
        "https://inara.cz/elite/starsystem/?search=a+b"
    ]


def test_map_addresses_without_a_system():
    host = "https://edgis.elitedangereuse.fr"
    useless = [host, f"{host}/", "HTTP://EDGIS.elitedangereuse.fr", f"{host}/static/sysmap.html?system=",
               f" {host}/static/SYSMAP.html?system= "]
    useful = [f"{host}/static/sysmap.html?system={{name}}", f"{host}/{{name_path}}",
              f"{host}/static/sysmap.html?system=Sol", "https://example.org", f"{host}.example.org/"]
    for text in useless:
        assert merge_templates({"edgis": text})["edgis"] == DEFAULT_TEMPLATES["edgis"]
    for text in useful:
        assert merge_templates({"EDGIS": text})["edgis"] == text


def test_counts_from_json_text(spark):
    texts = [None, "", "null", "[1]", "7", "{", '{"a":1} x', '{"a":1},{"b":2}', '{"A":1,"a":"2","b":4.9}',
             '{"a":null,"A":"no"}']
    sizes = column(spark, texts, "string", f"size({parse_counts('v')})")
    assert sizes == [0, 0, 0, 0, 0, 0, 0, 0, 3, 2]
    assert column(spark, texts, "string", alias_sum(parse_counts("v"), ["a"]))[-2:] == [3, 0]


@pytest.mark.parametrize(
    "types, subtypes, water, earth, expected",
    [
        ({"Planet": 6}, {"HIGH METAL CONTENT WORLD": 2, "Icy body": 1}, 1, 0, (2, 1, 0, 2)),
        ({"Planet": 2}, {"Rocky ice world": 3, "icy world": 1}, None, None, (0, 1, 3, 0)),
        ({"Planet": 9}, {"water giant": 1, "Gas giant with water based life": 2}, 0, 0, (0, 0, 0, 3)),
        ({}, {}, 0, 0, (0, 0, 0, 0)),
    ],
)
def test_derived_counts(spark, types, subtypes, water, earth, expected):
    df = spark.createDataFrame(
        [(types, subtypes, water, earth)], "t map<string,int>, s map<string,int>, w int, e int"
    )
    row = df.selectExpr(*derived_counts("t", "s", "w", "e").values()).first()
    assert tuple(row) == expected


HITS = """ref_ord int, rank int, reference_system string, name string, distance_ly double,
    total_bodies int, total_planets int, total_stars int, ringed_body_count int,
    water_world_count int, earthlike_world_count int, population bigint, faction_count int,
    controlling_faction string, body_type_counts map<string,int>,
    body_subtype_counts map<string,int>, ring_type_counts map<string,int>, claimable boolean"""


def make_hits(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(NASTY) if rng.random() < 0.2 else f"Sys {i}" + "y" * rng.randint(0, 60)
        rows.append((
            1, i + 1, "Home 'x'", name, round(rng.uniform(0, 2000), 2), rng.randint(0, 10**5),
            rng.randint(0, 9), 0, rng.randint(0, 10**6), rng.randint(0, 5), rng.randint(0, 5),
            rng.choice([None, 10**12]), rng.choice([None, 2]), rng.choice([None, "", "a;b"]),
            rng.choice([None, {}, {"Planet": 3, "A é": 1}]), {"Gas giant": 2}, {}, bool(i % 2)))
    return rows


@pytest.fixture(scope="module")
def results(spark):
    return complete_results(spark.createDataFrame(make_hits(120), HITS)).cache()


def test_csv_bytes(spark, results, tmp_path):
    write_csv(results, str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    expected = io.StringIO()
    writer = csv.writer(expected, delimiter=";")
    writer.writerow(CSV_HEADINGS)
    for row in results.orderBy("ref_ord", "rank").collect():
        values = []
        for source in CSV_HEADINGS.values():
            value = row[source]
            if source == "claimable":
                value = "yes" if value else "no"
            elif isinstance(value, dict):
                value = json.dumps(value, ensure_ascii=False, sort_keys=True)
            values.append(value)
        writer.writerow(values)
    assert part.read_bytes().decode() == expected.getvalue()


def test_json_rows(spark, results, tmp_path):
    write_json(results, str(tmp_path / "json"))
    (part,) = (tmp_path / "json").glob("part-*")
    got = [json.loads(line) for line in part.read_text().splitlines()]
    want = [r.asDict() for r in results.drop("ref_ord", "rank").collect()]
    assert got == want and list(got[0]) == list(want[0])


def plain_table(rows):
    lines = []
    for r in rows:
        counts = [f"{r[c] or 0:>{w}}" for c, w in [
            ("water_world_count", 3), ("earthlike_world_count", 4), ("hmcw_count", 5),
            ("icy_world_count", 4), ("rocky_icy_world_count", 5), ("gas_giant_count", 3),
            ("ringed_body_count", 4)]]
        lines.append(" ".join([f"{r['name'][:22]:<22}", f"{r['distance_ly']:>6.1f}", *counts]))
    return "\n".join([TABLE_HEAD, *lines])


def plain_message(rows, total, part=""):
    info = (f"Radius: **12.5 ly** | Filter: **any** | Claimable only: **no** | Limit: **200** | "
            f"Treffer: **{total}**")  # fmt: skip
    links = [f"- **{r['name']}** | [Inara]({r['inara_url']}) | [EDGIS]({r['edgis_url']})"
             for r in rows]
    return (f"## Home 'x'{part}\n{info}\n```text\n{plain_table(rows)}\n```\n"
            + "\n".join(links)).strip()


# with fewer rows to a block than a reference has, blocks are packed for themselves
@pytest.mark.parametrize("block_rows", [4096, 32])
@pytest.mark.parametrize("n", [1, 2, 7, 120])
def test_messages_pack_like_a_plain_loop(spark, results, n, block_rows, monkeypatch):
    monkeypatch.setattr(report, "BLOCK_ROWS", block_rows)
    rows = [r.asDict() for r in results.where(f"rank <= {n}").orderBy("rank").collect()]
    parts = [[]]
    for row in rows:
        if parts[-1] and len(plain_message([*parts[-1], row], n)) > MESSAGE_CAP:
            parts.append([])
        parts[-1].append(row)
    label = (lambda i: f"\nTeil {i}/{len(parts)}") if len(parts) > 1 else lambda i: ""
    want = [plain_message(part, n, label(i)) for i, part in enumerate(parts, start=1)]
    refs = spark.createDataFrame([(1, "Home 'x'"), (2, "Empty")], "ref_ord int, reference_system string")
    got = messages(results.where(f"rank <= {n}"), refs, radius=12.5, body_filter="any",
                   claimable_only=False, limit=200).orderBy("ref_ord", "part_no").collect()
    assert [r["content"] for r in got if r["ref_ord"] == 1] == want
    assert [r["part_count"] for r in got] == [len(parts)] * len(parts) + [1]
    assert got[-1]["content"] == (
        "## Empty\nRadius: **12.5 ly** | Filter: **any** | Claimable only: **no** | "
        "Limit: **200** | Treffer: **0**\n\nKeine Treffer."
    )


def test_a_long_reference_is_no_array(spark, monkeypatch):
    """References of many rows: the parts are those of a plain loop over the lengths."""
    monkeypatch.setattr(report, "BLOCK_ROWS", 256)
    n = 20_000
    schema = complete_results(spark.createDataFrame([], HITS)).schema
    values = {f.name: "null" for f in schema} | {
        "ref_ord": f"id div {n} + 1", "rank": f"id % {n} + 1", "reference_system": "'R'",
        "name": "concat('S', repeat('y', id * 7919 % 97))", "distance_ly": "1",
        "inara_url": "repeat('i', id * 104729 % 1700)", "edgis_url": "''",
    }
    hits = spark.range(2 * n).selectExpr(
        *[f"CAST({values[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
    )
    refs = spark.createDataFrame([(i, "R") for i in (1, 2, 3)], "ref_ord int, reference_system string")
    got = messages(hits, refs, radius=1.0, body_filter="any", claimable_only=False, limit=n)
    sizes = got.selectExpr(
        "ref_ord", "part_no", "part_count",
        "int((length(content) - length(replace(content, '[Inara]', ''))) / 7) AS n",
    ).collect()
    frame = len(f"## R\nRadius: **1.0 ly** | Filter: **any** | Claimable only: **no** | Limit: **{n}** | "
                f"Treffer: **{n}**\n```text\n{TABLE_HEAD}\n\n```\n")  # fmt: skip
    length = f"length({report.table_line()}) + 1 + length({report.LINK_LINE}) AS own"
    for ref in (1, 2):
        rows = hits.where(f"ref_ord = {ref}").orderBy("rank").selectExpr(length).collect()
        packed, used = [], MESSAGE_CAP
        for row in rows:
            if used + 1 + row["own"] > MESSAGE_CAP:
                packed.append(0)
                used = frame - 1
            used += 1 + row["own"]
            packed[-1] += 1
        found = sorted((r for r in sizes if r["ref_ord"] == ref), key=lambda r: r["part_no"])
        assert [r["n"] for r in found] == packed
        assert [r["part_no"] for r in found] == list(range(1, len(packed) + 1))
        assert {r["part_count"] for r in found} == {len(packed)}
    assert [r["n"] for r in sizes if r["ref_ord"] == 3] == [0]


def test_table_header_width():
    assert len(TABLE_HEADER) == 64
    assert TABLE_HEADER == "System                   Dist  WW  ELW  HMCW  Icy R-Icy  GG  Rng"
