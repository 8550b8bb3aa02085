"""Search predicates. A falsy argument (None, '', 0, []) means that the filter is not set."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_text(col: Column, needle: str) -> Column:
    """Case-insensitive substring; % and _ in the needle act as wildcards."""
    return col.ilike(f"%{needle}%")


def any_tech(col: Column, terms: list[str]) -> Column:
    """Shares a term with the list; never NULL for a stored array, even one holding a NULL element."""
    overlap = F.arrays_overlap(col, F.array(*[F.lit(t) for t in terms]))
    return F.when(col.isNotNull(), F.coalesce(overlap, F.lit(False)))


def all_tech(col: Column, terms: list[str]) -> Column:
    return reduce(and_, [F.array_contains(col, t) for t in terms], F.lit(True))


def one_tech(col: Column, term: str) -> Column:
    return F.array_contains(col, term)


def tech_count(col: Column) -> Column:
    """Array length; NULL for an empty array."""
    return F.nullif(F.array_size(col), F.lit(0))


def conjunction(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def job_filters(
    *,
    query: str | None = None,
    query_columns: tuple[str, ...] = ("title", "raw_description"),
    company: str | None = None,
    department: str | None = None,
    seniority: str | None = None,
    tech_stack: list[str] | None = None,
    remote_policy: str | None = None,
    salary_min: int | None = None,
    salary_max: int | None = None,
) -> Column:
    """All given filters combined; a posting's pay range must overlap the asked range."""
    conditions: list[Column] = []
    if query:
        hits = [contains_text(F.col(c), query) for c in query_columns]
        conditions.append(reduce(lambda a, b: a | b, hits))
    if company:
        conditions.append(contains_text(F.col("company"), company))
    for name, value in (("department", department), ("seniority", seniority), ("remote_policy", remote_policy)):
        if value:
            conditions.append(F.col(name) == value)
    if tech_stack:
        conditions.append(any_tech(F.col("tech_stack"), tech_stack))
    if salary_min:
        conditions.append(F.col("salary_max") >= salary_min)
    if salary_max:
        conditions.append(F.col("salary_min") <= salary_max)
    return conjunction(conditions)


def json_text(col: Column, key: str) -> Column:
    """A key of a JSON column as text."""
    return F.get_json_object(col, f"$.{key}")


def json_int(col: Column, key: str) -> Column:
    return json_text(col, key).cast("int")
