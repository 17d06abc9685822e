"""Counts and histograms over a system's bodies and rings.

``roll_up_nested`` works inside each record (no shuffle); ``roll_up_rows`` takes bodies as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starscan.functions import variants as V
from starscan.functions.counts import NO_COUNTS, count_equal, count_where, histogram

# --- fixed values: labels with a count column of their own ---
PLANET = "Planet"
STAR = "Star"
WATER_WORLD = "Water world"
EARTHLIKE_WORLD = "Earth-like world"
UNKNOWN = "Unknown"
# --- end of fixed values ---

# The two spellings of the subtype field differ in case only, so the second gets another name.
_BODY = "struct<type:variant,subType:variant,subtype:variant,rings:variant>"
_BODY_RENAMED = "array<struct<type:variant,subtype:variant,subtype_alt:variant,rings:variant>>"
_RING = "struct<type:variant,ringType:variant>"

# The same with texts for labels.
_PLAIN = "array<struct<type:string,subType:string,subtype:string,rings:array<struct<type:string,ringType:string>>>>"
_PLAIN_RENAMED = "array<struct<type:string,subtype:string,alt:string,rings:array<struct<type:string,alt:string>>>>"


def _loose_bodies(bodies: str) -> str:
    """array<struct<type, subtype, ringed, rings>> of bodies whose labels may be any JSON value."""
    # inner transforms read each VARIANT field once, outer ones clean up the plain values
    ring_labels = f"""transform(
      transform(filter(b.rings, r -> r IS NOT NULL), r -> struct(
        {V.loose_text("r.type")} AS type, {V.loose_text("r.ringType")} AS alt)),
      r -> coalesce({V.first_filled("r.type", "r.alt")}, '{UNKNOWN}'))"""
    return f"""transform(
      transform(CAST({V.objects(bodies, _BODY)} AS {_BODY_RENAMED}), b -> struct(
        {V.loose_text("b.type")} AS type,
        {V.loose_text("b.subtype")} AS subtype,
        {V.loose_text("b.subtype_alt")} AS alt,
        b.rings AS any_rings,
        {V.as_type("b.rings", f"array<{_RING}>")} AS rings)),
      b -> struct(
        coalesce({V.first_filled("b.type")}, '{UNKNOWN}') AS type,
        {V.first_filled("b.subtype", "b.alt")} AS subtype,
        CASE WHEN b.any_rings IS NULL THEN false WHEN b.rings IS NOT NULL THEN size(b.rings) > 0
          ELSE coalesce({V.loose_text("b.any_rings")} <> '', false) END AS ringed,
        CASE WHEN b.rings IS NULL THEN CAST(array() AS array<string>)
          ELSE {ring_labels} END AS rings))"""


def roll_up_nested(rows: DataFrame, bodies: str) -> DataFrame:
    """Adds the six counts and three histogram maps for a VARIANT column of bodies.

    Where every label is a string and ``rings`` a list, as in nearly all records, the bodies are read as
    texts at once; asking each value for its kind took most of an import's time.
    """
    first = rows.selectExpr(
        "*", f"array_compact(CAST({V.as_type(bodies, _PLAIN)} AS {_PLAIN_RENAMED})) AS _read"
    ).selectExpr("*", "array_compact(_read.rings) AS _lists")
    second = first.selectExpr("*", "array_compact(flatten(_lists)) AS _read_rings")
    labels = V.all_strings(
        "_read.type", "_read.subtype", "_read.alt", "_read_rings.type", "_read_rings.alt"
    )
    any_rings = f"{V.as_type(bodies, 'array<struct<rings:string>>')}.rings"
    third = second.selectExpr(
        "*",
        # a body without a list of rings may hold something else there
        f"""_read IS NULL OR {labels} AND (size(_lists) = size(_read)
          OR size(_lists) = size(array_compact({any_rings}))) AS _plain""",
    ).selectExpr("*", f"CASE WHEN NOT _plain THEN {_loose_bodies(bodies)} END AS _bodies")
    ring_label = f"coalesce({V.first_filled('r.type', 'r.alt')}, '{UNKNOWN}')"
    none = "CAST(array() AS array<string>)"
    labelled = third.selectExpr(
        "*",
        f"""CASE WHEN _read IS NULL THEN {none}
          WHEN _plain THEN transform(_read.type, t -> coalesce({V.first_filled("t")}, '{UNKNOWN}'))
          ELSE _bodies.type END AS _types""",
        f"""CASE WHEN _read IS NULL THEN {none}
          WHEN _plain THEN array_compact(transform(_read, b -> {V.first_filled("b.subtype", "b.alt")}))
          ELSE array_compact(_bodies.subtype) END AS _subtypes""",
        f"""CASE WHEN _read IS NULL THEN {none}
          WHEN _plain THEN transform(_read_rings, r -> {ring_label})
          ELSE flatten(_bodies.rings) END AS _rings""",
        f"""CASE WHEN _read IS NULL THEN 0 WHEN _plain THEN {count_where("_lists", "size(i) > 0")}
          ELSE {count_where("_bodies.ringed", "i")} END AS _ringed""",
    )
    return labelled.selectExpr(
        *[f"`{name}`" for name in rows.columns],
        "size(_types) AS total_bodies",
        f"{count_equal('_types', PLANET)} AS total_planets",
        f"{count_equal('_types', STAR)} AS total_stars",
        "_ringed AS ringed_body_count",
        f"{count_equal('_subtypes', WATER_WORLD)} AS water_world_count",
        f"{count_equal('_subtypes', EARTHLIKE_WORLD)} AS earthlike_world_count",
        f"{histogram('_types')} AS body_type_counts",
        f"{histogram('_subtypes')} AS body_subtype_counts",
        f"{histogram('_rings')} AS ring_type_counts",
    )


_CONDITIONS = {
    "total_bodies": "true",
    "total_planets": f"type = '{PLANET}'",
    "total_stars": f"type = '{STAR}'",
    "ringed_body_count": "ring IS NOT NULL",
    "water_world_count": f"subtype = '{WATER_WORLD}'",
    "earthlike_world_count": f"subtype = '{EARTHLIKE_WORLD}'",
}


def _total(condition: str, weight: str, name: str) -> Column:
    return F.expr(f"CAST(sum(CASE WHEN {condition} THEN {weight} ELSE 0 END) AS int) AS {name}")


def body_totals(bodies: DataFrame, key: str) -> DataFrame:
    """The six counts per system from body rows (``type``, ``subtype``, ``ring``)."""
    return bodies.groupBy(key).agg(*[_total(held, "1", name) for name, held in _CONDITIONS.items()])


def label_counts(bodies: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): one histogram as rows; bodies without the label are skipped."""
    return bodies.where(f"{label} IS NOT NULL").groupBy(key, label).agg(F.count("*").alias("n"))


def roll_up_rows(bodies: DataFrame, key: str) -> DataFrame:
    """Counts and histogram maps per system from body rows.

    Bodies are first counted per (system, kind of label, label), which combines map-side, so a
    system with very many bodies reaches its final group as a handful of rows. These go to their
    system as plain rows: gathered before the shuffle, each would travel as a list of its own.
    """
    labels = {
        "type": "body_type_counts",
        "subtype": "body_subtype_counts",
        "ring": "ring_type_counts",
    }
    kinds = ", ".join(f"'{label}', {label}" for label in labels)
    counted = (
        bodies.selectExpr(f"`{key}`", f"stack({len(labels)}, {kinds}) AS (kind, label)")
        # a body without a type is a body all the same
        .where("kind = 'type' OR label IS NOT NULL")
        .groupBy(key, "kind", "label")
        .agg(F.count("*").alias("n"))
    )
    totals = []
    for name, held in _CONDITIONS.items():
        label, _, rest = held.partition(" ")
        condition = f"kind = '{label}' AND label {rest}" if rest else "kind = 'type'"
        totals.append(_total(condition, "n", name))
    # collect_list skips nulls; a label comes once, so it alone sets the order
    gathered = [
        F.expr(
            "map_from_entries(sort_array(collect_list(CASE WHEN"
            f" kind = '{label}' AND label IS NOT NULL THEN struct(label, CAST(n AS int) AS n) END))) AS {name}"
        )
        for label, name in labels.items()
    ]
    return counted.repartition(key).groupBy(key).agg(*totals, *gathered)


def without_bodies(rows: DataFrame, counts: list[str], histograms: list[str]) -> DataFrame:
    """Zero counts and empty maps where an outer join found no bodies."""
    filled = [(name, "0") for name in counts] + [(name, NO_COUNTS) for name in histograms]
    return rows.withColumns({name: F.expr(f"coalesce({name}, {empty})") for name, empty in filled})
