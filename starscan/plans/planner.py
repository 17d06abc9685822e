"""Search to finished results: the 24-column rows, and the messages made from them.

``points`` are the references' coordinates (``search.reference_points``) when the caller has
them already; otherwise the names are looked up in ``systems``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from starscan.operators.report import complete_results, messages
from starscan.operators.search import (
    clean_references,
    reference_table,
    search_many,
    search_one,
)


def query_systems(
    systems: DataFrame,
    reference: str,
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    include_links: bool = True,
    templates: Mapping[str, str] | None = None,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """The nearest ``limit`` systems around one reference, in order."""
    hits = search_one(
        systems,
        reference,
        radius,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
        points=points,
    )
    return complete_results(hits, include_links=include_links, templates=templates)


def query_multiple_systems(
    systems: DataFrame,
    references: Iterable[str],
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    include_links: bool = True,
    templates: Mapping[str, str] | None = None,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """All references in one relation: ``ref_ord`` tells the list position, ``rank`` the place
    within a reference. Order by both to get the concatenated results."""
    hits = search_many(
        systems,
        references,
        radius,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
        points=points,
    )
    return complete_results(hits, include_links=include_links, templates=templates)


def report_messages(
    systems: DataFrame,
    references: Iterable[str],
    radius: float,
    *,
    body_filter: str = "ww_or_elw",
    claimable_only: bool = False,
    limit: int = 200,
    templates: Mapping[str, str] | None = None,
    points: Sequence[tuple] | None = None,
) -> DataFrame:
    """The messages of every reference, also of those without hits."""
    names = clean_references(references)
    results = query_multiple_systems(
        systems,
        names,
        radius,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
        templates=templates,
        points=points,
    )
    listed = reference_table(systems.sparkSession, [(name, 0.0, 0.0, 0.0) for name in names])
    return messages(
        results,
        listed.select("ref_ord", "reference_system"),
        radius=radius,
        body_filter=body_filter,
        claimable_only=claimable_only,
        limit=limit,
    )
