"""Loosely typed JSON values held as VARIANT."""

from __future__ import annotations


def get(value: str, path: str, type_name: str) -> str:
    return f"try_variant_get({value}, '{path}', '{type_name}')"


def as_type(value: str, type_name: str) -> str:
    return get(value, "$", type_name)


def kind(value: str) -> str:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, ARRAY<..> or OBJECT<..>."""
    return f"schema_of_variant({value})"


def is_object(value: str) -> str:
    return f"coalesce(startswith({kind(value)}, 'OBJECT'), false)"


def is_string(value: str) -> str:
    return f"coalesce({kind(value)} = 'STRING', false)"


def text(value: str) -> str:
    """The value as text; booleans are spelled ``True`` / ``False``."""
    plain = as_type(value, "string")
    return f"CASE WHEN {kind(value)} = 'BOOLEAN' THEN initcap({plain}) ELSE {plain} END"


def loose_text(value: str) -> str:
    """``text`` of a value that is not empty, zero or false; '' or NULL for those.

    Reads the value once in the common case; turn '' into NULL where it is cheap to name the
    result twice.
    """
    plain, shape = as_type(value, "string"), kind(value)
    return f"""CASE
      WHEN {shape} = 'STRING' THEN {plain}
      WHEN {shape} = 'BOOLEAN' THEN CASE WHEN {as_type(value, "boolean")} THEN 'True' END
      WHEN {shape} RLIKE '^(ARRAY|OBJECT)' THEN CASE WHEN {plain} NOT IN ('[]', '{{}}') THEN {plain} END
      WHEN {shape} <> 'VOID' THEN CASE WHEN {as_type(value, "double")} <> 0 THEN {plain} END
    END"""


def first_filled(*texts: str) -> str:
    """The first text that is neither NULL nor ''."""
    return f"coalesce({', '.join(f"nullif({t}, '')" for t in texts)})"


# How the text of a JSON number, boolean, array or object begins; some strings begin like that, too.
_NO_STRING = r"(?m)^(?:[-0-9\[{]|true|false|NaN|Infinity)"


def all_strings(*texts: str) -> str:
    """Whether no text of some arrays<string> can stand for anything but a JSON string.

    The texts are VARIANT values read as ``string``, which is cheaper than to ask each for its kind.
    False says nothing: the kinds must be asked for.
    """
    return f"NOT array_join(concat({', '.join(texts)}), '\\n') RLIKE r'{_NO_STRING}'"


def objects(value: str, struct_type: str) -> str:
    """The object elements of an array value as structs; [] when it is not an array."""
    items = as_type(value, f"array<{struct_type}>")
    return f"coalesce(filter({items}, o -> o IS NOT NULL), CAST(array() AS array<{struct_type}>))"
