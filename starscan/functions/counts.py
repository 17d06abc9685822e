"""Histograms as maps, their canonical JSON text, and the counts derived from them."""

from __future__ import annotations

from collections.abc import Iterable

NO_COUNTS = "CAST(map() AS map<string,int>)"

# --- fixed values: body subtype names that make up each derived count ---
HIGH_METAL_ALIASES = ["High metal content world", "High metal content body"]
ICY_ALIASES = ["Icy body", "Icy world"]
ROCKY_ICE_ALIASES = ["Rocky ice body", "Rocky ice world"]
GAS_GIANT_ALIASES = [
    "Gas giant with water based life",
    "Gas giant with ammonia based life",
    "Sudarsky class i gas giant",
    "Sudarsky class ii gas giant",
    "Sudarsky class iii gas giant",
    "Sudarsky class iv gas giant",
    "Sudarsky class v gas giant",
    "Helium rich gas giant",
    "Water giant",
    "Gas giant",
]
# --- end of fixed values ---


def count_where(items: str, condition: str) -> str:
    """Number of elements for which ``condition`` on ``i`` holds."""
    return f"size(filter({items}, i -> {condition}))"


def count_equal(items: str, label: str) -> str:
    """Number of elements equal to a label; compiled, unlike a lambda."""
    return f"(size({items}) - size(array_remove({items}, '{label}')))"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _runs(items: str, key: str) -> str:
    """Where runs of equal keys start in sorted ``items``; ``key`` is an expression of ``item``."""
    previous = key.replace("item", f"get({items}, i - 1)")
    return f"""filter(sequence(0, size({items}) - 1), i -> i = 0
      OR {key.replace("item", f"get({items}, i)")} <> {previous})"""


def histogram(labels: str) -> str:
    """array<string> without nulls -> map of label to number of occurrences.

    Sorts the labels and counts runs of equal ones, so the work does not grow with the number of
    different labels. Labels that all differ need no runs; lambdas are not compiled by Spark.
    """
    counted = """map_from_arrays(
      transform(starts, i -> get(sorted, i)),
      transform(starts, (start, n) -> coalesce(get(starts, n + 1), size(sorted)) - start))"""
    runs = _bound(_runs("sorted", "item"), "starts", counted)
    in_runs = _bound(f"sort_array({labels})", "sorted", runs)
    return f"""CASE WHEN size({labels}) = 0 THEN {NO_COUNTS}
      WHEN size(array_distinct({labels})) = size({labels})
        THEN map_from_arrays(sort_array({labels}), array_repeat(1, size({labels})))
      ELSE {in_runs} END"""


def merged_histogram(parts: str, label: str) -> str:
    """Adds up partial counts: array<struct<label, n>> -> map of label to total, by runs."""
    summed = f"""map_from_arrays(
      transform(starts, i -> get(sorted, i).{label}),
      transform(starts, (start, k) -> aggregate(
        slice(sorted, start + 1, coalesce(get(starts, k + 1), size(sorted)) - start), 0,
        (total, p) -> total + CAST(p.n AS int))))"""
    runs = _bound(_runs("sorted", f"item.{label}"), "starts", summed)
    return _bound(
        f"sort_array({parts})", "sorted", f"CASE WHEN size(sorted) = 0 THEN {NO_COUNTS} ELSE {runs} END"
    )


def canonical_json(counts: str) -> str:
    """Keys sorted, ``", "`` and ``": "`` separators, non-ASCII text kept."""
    member = f"concat(btrim(to_json(array(k)), '[]'), ': ', element_at({counts}, k))"
    members = f"transform(sort_array(map_keys({counts})), k -> {member})"
    return f"concat('{{', array_join({members}, ', '), '}}')"


def parse_counts(json_text: str) -> str:
    """JSON object text to a map; null, malformed or non-object text gives an empty map.

    Values that are not numbers become null, which ``alias_sum`` counts as zero. The parser
    would ignore anything after the first value, so the text is parsed as an array's only item.
    Values that are numbers are read at once; the lambda for the others is not compiled by Spark,
    which would parse again there for every use.
    """
    parsed = f"try_parse_json(concat('[', {json_text}, ']'))"
    numbers = f"try_variant_get({parsed}, '$', 'array<map<string,int>>')"
    items = f"try_variant_get({parsed}, '$', 'array<variant>')"
    members = f"try_variant_get(get({items}, 0), '$', 'map<string,variant>')"
    counts = f"transform_values({members}, (k, v) -> try_variant_get(v, '$', 'int'))"
    return f"""coalesce(CASE WHEN size({numbers}) = 1 THEN get({numbers}, 0)
      WHEN size({items}) = 1 THEN {counts} END, {NO_COUNTS})"""


def alias_sum(counts: str, aliases: Iterable[str]) -> str:
    """Sum of the values whose key is one of the aliases in any case."""
    wanted = ", ".join(f"'{a}'" for a in sorted({alias.casefold() for alias in aliases}))
    hits = f"filter(map_entries({counts}), e -> lower(e.key) IN ({wanted}))"
    return f"coalesce(aggregate({hits}, 0, (total, e) -> total + coalesce(e.value, 0)), 0)"


def derived_counts(
    types: str, subtypes: str, water_worlds: str, earthlike_worlds: str
) -> dict[str, str]:
    """The four counts shown in reports next to the stored ones.

    Without any named gas giant, every planet that belongs to no other group counts as one.
    """
    groups = {
        "hmcw_count": alias_sum(subtypes, HIGH_METAL_ALIASES),
        "icy_world_count": alias_sum(subtypes, ICY_ALIASES),
        "rocky_icy_world_count": alias_sum(subtypes, ROCKY_ICE_ALIASES),
    }
    named = alias_sum(subtypes, GAS_GIANT_ALIASES)
    worlds = [f"coalesce({water_worlds}, 0)", f"coalesce({earthlike_worlds}, 0)"]
    others = " + ".join([*worlds, *groups.values()])
    remaining = f"greatest(0, {alias_sum(types, ['Planet'])} - ({others}))"
    return groups | {
        "gas_giant_count": f"CASE WHEN {named} > 0 THEN {named} ELSE {remaining} END"
    }
