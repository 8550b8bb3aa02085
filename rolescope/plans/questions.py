"""Named questions over the jobs and profile tables, and free Spark SQL over the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import contains_text, one_tech
from .reports import AI_TERMS
from .search import format_jobs

LIMIT = 20


def run_sql(
    spark: SparkSession, sql: str, jobs: DataFrame, profiles: DataFrame | None = None, padded: bool = False
) -> DataFrame:
    """Rows of one SELECT over the views ``jobs`` and ``company_profiles``.

    The text runs as a subquery, so Spark itself refuses anything that is not a single query. With
    ``padded`` the answer has all output columns of a posting.
    """
    jobs.createOrReplaceTempView("jobs")
    if profiles is not None:
        profiles.createOrReplaceTempView("company_profiles")
    query = sql.strip().rstrip(";")
    answer = spark.sql(f"SELECT * FROM (\n{query}\n) AS answer")
    return format_jobs(answer) if padded else answer


def _first(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    ordered = rows.orderBy(*[F.asc_nulls_last(c) for c in order])
    return ordered if limit is None else ordered.limit(limit)


def hiring_department(jobs: DataFrame, department: str = "Engineering", limit: int = LIMIT) -> DataFrame:
    """Companies with an opening in a department."""
    return _first(jobs.where(F.col("department") == department).select("company").distinct(), ["company"], limit)


def with_tech(jobs: DataFrame, tech: str, limit: int = LIMIT) -> DataFrame:
    hits = jobs.where(one_tech(F.col("tech_stack"), tech))
    return _first(hits, ["company", "title", "id"], limit).select("company", "title")


def level_at(jobs: DataFrame, company: str, seniority: str = "Senior", limit: int = LIMIT) -> DataFrame:
    hits = jobs.where(contains_text(F.col("company"), company) & (F.col("seniority") == seniority))
    return _first(hits, ["title", "department", "id"], limit).select("title", "department")


def with_signal(profiles: DataFrame, signal: str) -> DataFrame:
    return profiles.where(F.array_contains("hiring_signals", signal)).select("company", "hiring_signals")


def remote_with_tech(jobs: DataFrame, tech: str, limit: int = LIMIT) -> DataFrame:
    return with_tech(jobs.where(F.col("remote_policy") == "Remote"), tech, limit)


def top_companies(profiles: DataFrame, k: int = 10) -> DataFrame:
    ordered = profiles.orderBy(F.desc_nulls_last("total_jobs"), "company", "ats")
    return ordered.limit(k).select("company", "total_jobs")


def level_pay_place(jobs: DataFrame, seniority: str, pay: int, place: str) -> DataFrame:
    """Postings of a level that pay above an amount in a place."""
    return jobs.where(
        (F.col("seniority") == seniority) & (F.col("salary_max") > pay) & contains_text(F.col("location"), place)
    )


def remote_level_department(jobs: DataFrame, seniority: str = "Senior", department: str = "Engineering") -> DataFrame:
    return jobs.where(
        (F.col("remote_policy") == "Remote") & (F.col("seniority") == seniority) & (F.col("department") == department)
    )


def hiring_ai_ml(jobs: DataFrame) -> DataFrame:
    """Companies with a posting about machine learning, by title or technologies."""
    terms = F.array(*[F.lit(t) for t in AI_TERMS])
    in_title = contains_text(F.col("title"), "machine learning") | contains_text(F.col("title"), "AI/ML")
    hits = jobs.where(in_title | F.coalesce(F.arrays_overlap("tech_stack", terms), F.lit(False)))
    return hits.select("company").distinct().orderBy("company")


def profile_department(profiles: DataFrame, department: str, least: int) -> DataFrame:
    """Companies with at least ``least`` postings in a department, read from the profiles."""
    n = F.try_element_at("departments", F.lit(department))
    return profiles.where(n >= least).select("company", "ats", n.alias("postings"))


def level_tech_pay(jobs: DataFrame, seniority: str, tech: str, pay: int) -> DataFrame:
    return jobs.where(
        (F.col("seniority") == seniority) & one_tech(F.col("tech_stack"), tech) & (F.col("salary_max") > pay)
    )


def company_with_tech(jobs: DataFrame, company: str, tech: str) -> DataFrame:
    return jobs.where(contains_text(F.col("company"), company) & one_tech(F.col("tech_stack"), tech))
