"""The term dictionaries as DuckDB maps and list expressions."""

from __future__ import annotations

from ..functions.terms import SKILLS, TECH
from .views_sql import literal


def _map(dictionary: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in dictionary.items()) + "}"


TECH_MAP, SKILL_MAP = _map(TECH), _map(SKILLS)


def canonical(term: str, mapping: str) -> str:
    return f"coalesce({mapping}[lower(trim({term}))], lower(trim({term})), '')"


def canonical_list(column: str, mapping: str) -> str:
    """Distinct canonical terms of a list in order; NULL gives an empty list."""
    mapped = f"list_transform({column}, lambda t: {canonical('t', mapping)})"
    return f"coalesce(list_sort(list_distinct(list_filter({mapped}, lambda t: t <> ''))), CAST([] AS VARCHAR[]))"
