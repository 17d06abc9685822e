"""The test tables seen as a star catalogue: orders are systems, line items their bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starscan.operators.rollup import roll_up_rows, without_bodies
from starscan.schema import COUNT_COLUMNS, HISTOGRAM_COLUMNS

# Given schemas spare a look into the files for every query.
TABLES = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_returnflag string, l_linestatus string""",
    "part": "p_partkey bigint, p_type string, p_size int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": """event_id bigint, ts timestamp, user_id bigint, event_type string, value double,
        props string""",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Counted keys of 8 bytes; as a broadcast hash table well under 100 MB.
MAX_BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('addr:', o_orderkey) AS system_key",
        "o_orderkey AS system_address",
        "concat('Star ', o_orderkey) AS name",
        "((o_orderkey * 37) % 401 - 200) / 8D AS x",
        "((o_orderkey * 53 + o_custkey) % 401 - 200) / 8D AS y",
        "((o_orderkey * 91) % 401 - 200) / 8D AS z",
        "floor(o_totalprice) AS population",
        """CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN '' ELSE o_orderpriority END
           AS controlling_faction""",
        "CASE WHEN o_orderstatus = 'O' OR o_custkey % 3 = 0 THEN 1 ELSE 0 END AS faction_count",
    )


def crowded(rows: DataFrame) -> DataFrame:
    """Stars or systems, every second one pulled into a cube two light-years wide."""
    return rows.withColumns(
        {a: F.expr(f"CASE WHEN system_address % 2 = 0 THEN {a} / 32D ELSE {a} END") for a in ("x", "y", "z")}
    )


def bodies(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """All bodies, or those of the orders in ``only`` (``l_orderkey``): other line items are
    dropped before they are joined to their parts."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    if only is not None:
        items = items.join(only, "l_orderkey", "left_semi")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).selectExpr(
        "l_orderkey AS system_address",
        "CASE l_returnflag WHEN 'N' THEN 'Planet' WHEN 'R' THEN 'Star' ELSE 'Unknown' END AS type",
        """CASE WHEN l_returnflag <> 'R' THEN CASE p_type
             WHEN 'ECONOMY' THEN 'Water world'
             WHEN 'SMALL' THEN 'Earth-like world'
             WHEN 'MEDIUM' THEN 'High metal content world'
             WHEN 'PROMO' THEN 'icy body'
             WHEN 'LARGE' THEN 'Rocky ice body'
             WHEN 'STANDARD' THEN 'Gas giant' END END AS subtype""",
        """CASE WHEN l_linestatus = 'O' THEN
             CASE WHEN p_size % 2 = 0 THEN 'Icy' ELSE 'Metallic' END END AS ring""",
    )


def systems(
    spark: SparkSession, sf_dir: str, near: str | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """The whole catalogue, or the part of it that passes ``near``, a predicate on the star's
    own columns, or that has a ``system_key`` in ``keys``."""
    chosen, only = stars(spark, sf_dir), None
    if near is not None:
        chosen = chosen.where(near)
    if keys is not None:
        chosen = chosen.join(keys, "system_key", "left_semi")
    if near is not None or keys is not None:
        only = chosen.selectExpr("system_address AS l_orderkey")
        if only.count() <= MAX_BROADCAST_KEYS:
            # spares a shuffle of all line items, which Spark would plan from file sizes
            only = F.broadcast(only)
    rolled = roll_up_rows(bodies(spark, sf_dir, only), "system_address")
    return without_bodies(
        chosen.join(rolled, "system_address", "left"), COUNT_COLUMNS, HISTOGRAM_COLUMNS
    )
