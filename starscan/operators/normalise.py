"""One loosely typed record to one typed row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starscan.functions import variants as V
from starscan.functions.geometry import AXES

# the first of the id fields that can be read as a whole number
ADDRESS = f"""coalesce({", ".join(
    V.as_type(f"record.{field}", "bigint")
    for field in ("id64", "systemAddress", "system_address"))})"""

POPULATION = V.as_type("record.population", "bigint")

SYSTEM_KEY = """CASE
  WHEN system_address IS NOT NULL THEN concat('addr:', system_address)
  WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
    THEN concat('coords:', lower(name), format_string('|%.8f|%.8f|%.8f', x, y, z))
  ELSE concat('name:', lower(name)) END"""


COORDS = V.as_type("record.coords", "map<string,variant>")


def coordinate(axis: str) -> str:
    """``coords.<axis>`` when that key is there, even if null; the top-level field otherwise.
    ``_coords`` is ``COORDS``."""
    value = f"""CASE WHEN coalesce(map_contains_key(_coords, '{axis}'), false)
      THEN _coords['{axis}'] ELSE record.{axis} END"""
    return V.as_type(value, "double")


def controlling_faction() -> str:
    """An object gives its name (no further fallback), text gives itself, anything else the
    separate name field."""
    value = "record.controllingFaction"
    return f"""CASE
      WHEN {V.is_object(value)} THEN coalesce(
        {V.first_filled(V.loose_text(V.get(value, "$.name", "variant")))},
        {V.get(value, "$.faction", "string")})
      WHEN {V.is_string(value)} THEN {V.as_type(value, "string")}
      ELSE {V.as_type("record.controllingFactionName", "string")} END"""


def faction_count() -> str:
    """Distinct faction names together with the controlling one.

    A JSON null inside the list counts as a faction called "None". A truthy value that is not
    a list leaves only the controlling faction to count.
    """
    members = V.as_type("record.factions", "array<variant>")
    named = V.first_filled(
        V.loose_text(V.get("m", "$.name", "variant")),
        V.loose_text(V.get("m", "$.faction", "variant")),
    )
    labels = f"""transform({members}, m -> CASE
      WHEN {V.kind("m")} = 'VOID' THEN 'None'
      WHEN {V.is_object("m")} THEN {named}
      ELSE {V.text("m")} END)"""
    own = "CASE WHEN controlling_faction <> '' THEN 1 ELSE 0 END"
    distinct = f"array_distinct(array_append({labels}, controlling_faction))"
    return f"""CASE WHEN {members} IS NULL THEN {own}
      ELSE size(filter({distinct}, label -> label <> '')) END"""


def normalise(records: DataFrame) -> DataFrame:
    """Adds the typed columns to rows with a ``record``; nameless records get a null name."""
    read = records.selectExpr(
        "*",
        f"{COORDS} AS _coords",
        f"{V.loose_text('record.name')} AS _name",
        f"{V.loose_text('record.system_name')} AS _system_name",
    )
    typed = read.selectExpr(
        *records.columns,
        f"{V.first_filled('_name', '_system_name')} AS name",
        f"{ADDRESS} AS system_address",
        *[f"{coordinate(axis)} AS {axis}" for axis in AXES],
        f"{POPULATION} AS population",
        f"{controlling_faction()} AS controlling_faction",
    )
    return typed.selectExpr(
        "*", f"{SYSTEM_KEY} AS system_key", f"{faction_count()} AS faction_count"
    )
