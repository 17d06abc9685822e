"""Raw catalogue records derived from the orders table, one JSON object per order.

Every loosely typed form a dump may hold occurs: numeric and missing names, ids under three
keys and as text, coordinates nested, top-level, null or as text, factions as text or objects,
bodies that are no objects. Which form a record takes follows from its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.demo.starmap import table

# SQL expressions over one order: k its key, c its customer, s its status, p its priority,
# n its population. Each gives the text of some JSON members, or null for none.
MEMBERS = [
    """CASE k % 11
         WHEN 0 THEN format_string('"system_name": "Sys %d"', k)
         WHEN 1 THEN format_string('"name": %d', k)
         WHEN 2 THEN format_string('"name": "", "system_name": "Alt %d"', k)
         WHEN 3 THEN '"name": null'
         ELSE format_string('"name": "Star %d"', k) END""",
    """CASE k % 7
         WHEN 1 THEN format_string('"id64": "bad", "systemAddress": "%d"', k)
         WHEN 2 THEN format_string('"id64": null, "system_address": %d', k)
         WHEN 4 THEN format_string('"id64": %d', k * 1000)
         WHEN 5 THEN format_string('"id64": %d', k * 1000)
         WHEN 6 THEN format_string('"id64": %d.75', k) END""",
    """CASE k % 5
         WHEN 0 THEN format_string('"x": %d, "y": %d.5, "z": %d', x, abs(y), z)
         WHEN 1 THEN format_string('"coords": {"x": null, "y": %d, "z": %d}, "x": 7', y, z)
         WHEN 2 THEN format_string('"coords": {"y": %d, "z": %d}, "x": 7', y, z)
         WHEN 3 THEN format_string('"coords": {"x": "%d", "y": "n/a", "z": "%d.25"}', x, abs(z))
         WHEN 4 THEN format_string('"coords": {"x": %d, "y": %d, "z": %d.125}', x, y, abs(z)) END""",
    """CASE k % 4
         WHEN 1 THEN format_string('"population": %d', n)
         WHEN 2 THEN format_string('"population": %d.9', n)
         WHEN 3 THEN format_string('"population": "%d"', n) END""",
    """CASE
         WHEN k % 13 = 0 THEN '"controllingFaction": {}, "controllingFactionName": "Z"'
         WHEN s = 'O' THEN concat('"controllingFaction": "', p, '"')
         WHEN s = 'P' THEN concat('"controllingFaction": {"faction": "', p, '"}')
         WHEN c % 2 = 0 THEN concat('"controllingFactionName": "', p, '"') END""",
    """CASE c % 6
         WHEN 1 THEN '"factions": ["a", {"name": "b"}, {"faction": "a"}, null]'
         WHEN 2 THEN '"factions": {"k": 1}'
         WHEN 3 THEN concat('"factions": ["x", "', p, '"]')
         WHEN 4 THEN '"factions": []'
         WHEN 5 THEN format_string('"factions": [%d, %d, "", {"name": ""}]', k, k % 3) END""",
    """concat('"bodies": [', array_join(transform(
         CASE WHEN c % 6 > 0 THEN sequence(1, c % 6) END,
         i -> CASE (k + i) % 5
           WHEN 0 THEN '7'
           WHEN 1 THEN '{"type": "Planet", "subType": "Water world", "rings": [{"type": "Icy"}, 3]}'
           WHEN 2 THEN '{"type": "Star", "rings": []}'
           WHEN 3 THEN '{"subtype": "Earth-like world", "rings": [{"ringType": "Metallic"}, {}]}'
           WHEN 4 THEN '{"type": "Planet", "subType": "Icy body é", "rings": ["r"]}' END),
       ', '), ']')""",
]


def raw_records(spark: SparkSession, sf_dir: str, edition: int = 1) -> DataFrame:
    """(record_no, value): the JSON text of each record. A second ``edition`` describes the
    same systems with a population larger by one."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "o_orderstatus AS s",
        "o_orderpriority AS p",
        f"floor(o_totalprice) + {edition - 1} AS n",
        *[f"(o_orderkey * {m}) % 401 - 200 AS {axis}" for m, axis in zip((37, 53, 91), "xyz")],
    )
    return orders.selectExpr(
        "k AS record_no", f"concat('{{', concat_ws(', ', {', '.join(MEMBERS)}), '}}') AS value"
    )


def write_dump(
    records: DataFrame, path: str, *, rows_per_file: int = 50_000, compression: str = "none"
) -> None:
    """Records as JSON-array dump files, one object per line, in ``record_no`` order.

    The files' ends, 16 bytes a file, are broadcast. After a join by shuffle Spark would take the
    union for dealt by file already and leave the repartition out; once adaptive execution has
    turned that join into a broadcast, each file's lines would lie in several tasks.
    """
    lines = records.selectExpr(
        f"record_no div {rows_per_file} AS file_no", "record_no AS line_no", "value"
    )
    ends = lines.groupBy("file_no").agg({"line_no": "max"}).toDF("file_no", "last")
    brackets = ends.selectExpr(
        "file_no",
        "inline(array(struct(-1L AS line_no, '[' AS value), struct(last + 1 AS line_no, ']' AS value)))",
    )
    separated = lines.join(F.broadcast(ends), "file_no").selectExpr(
        "file_no", "line_no", "concat(value, CASE WHEN line_no < last THEN ',' ELSE '' END) AS value"
    )
    (
        separated.unionByName(brackets)
        .repartition("file_no")
        .sortWithinPartitions("file_no", "line_no")
        .select("file_no", "value")
        .write.partitionBy("file_no")
        .option("compression", compression)
        .text(path)
    )
