"""Distances, rounding and the cell grid behind the radius operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

AXES = ("x", "y", "z")
REF_AXES = ("rx", "ry", "rz")


def number(value: float) -> str:
    """A double literal."""
    if not math.isfinite(value):
        return f"double('{value}')"
    return f"({float(value)!r}D)"


def distance(point: Sequence[str], origin: Sequence[str]) -> str:
    squares = [f"({p} - {o}) * ({p} - {o})" for p, o in zip(point, origin)]
    return f"sqrt({' + '.join(squares)})"


def round2(value: str) -> str:
    """Two decimals, halves away from zero after scaling (``round(1.005, 2)`` is 1.0)."""
    return f"(round({value} * 100D) / 100D)"


def span(axis: str, low: float, high: float, radius: float) -> str:
    slack = 1e-9 * max(1.0, abs(low), abs(high), abs(radius))
    return f"{axis} BETWEEN {number(low - radius - slack)} AND {number(high + radius + slack)}"


def around(origins: Sequence[Sequence[float]], radius: float) -> str:
    """The axis-aligned box that holds the balls around all origins.

    Plain comparisons with literals, so that Parquet min/max statistics can skip row groups;
    widened so that rounding cannot lose a point.
    """
    ranges = [(min(values), max(values)) for values in zip(*origins)]
    return " AND ".join(span(axis, *range_, radius) for axis, range_ in zip(AXES, ranges))


def cell_size(radius: float, largest_coordinate: float) -> float:
    """Edge length for which every point within ``radius`` of an origin lies in the origin's
    cell or one of its neighbours.

    Any edge of at least the radius will do; the margins keep that true when ``x / edge`` is
    rounded, also for far-out origins.
    """
    return max(radius * (1 + 1e-6), abs(largest_coordinate) * 1e-9, 1.0)


def cell(point: Sequence[str], edge: float) -> list[str]:
    return [f"floor({axis} / {number(edge)})" for axis in point]


def neighbour_cells(origin: Sequence[str], edge: float) -> str:
    """array<struct<cx,cy,cz>>: the origin's cell and its 26 neighbours."""
    cx, cy, cz = cell(origin, edge)
    return f"""transform(sequence(0, 26), i -> struct(
      {cx} + i div 9 - 1 AS cx, {cy} + (i div 3) % 3 - 1 AS cy, {cz} + i % 3 - 1 AS cz))"""


def is_searchable(radius: float) -> bool:
    return not math.isnan(radius) and radius >= 0
