"""Search, lookup and paging over the jobs table."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import contains_text, job_filters
from ..functions.terms import no_terms
from ..operators.matching import parse_ids
from ..schemas import JOB_FIELDS, JOBS

BM25_K, BM25_B = 1.2, 0.75
_BLANK_IF_ABSENT = {"job_id", "company", "ats", "title", "location", "job_summary", "url"}
_ARRAYS = {"tech_stack", "skills", "pain_points"}


def job_projection(jobs: DataFrame) -> DataFrame:
    return jobs.select(*JOB_FIELDS)


def format_jobs(rows: DataFrame) -> DataFrame:
    """All output columns from rows that may lack some: absent text is '', absent or NULL lists are empty."""

    def field(name: str):
        if name not in rows.columns:
            if name in _ARRAYS:
                return no_terms()
            return F.lit("" if name in _BLANK_IF_ABSENT else None).cast(JOBS[name].dataType)
        return F.coalesce(F.col(name), no_terms()) if name in _ARRAYS else F.col(name)

    return rows.select(*[field(f).alias(f) for f in JOB_FIELDS])


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order, NULLs last. A heap of ``offset + limit`` rows; ``ranking.deep_page`` is for those far down."""
    return rows.orderBy(*[F.asc_nulls_last(c) for c in order]).offset(offset).limit(limit)


def search_jobs(jobs: DataFrame, **filters) -> DataFrame:
    """Postings that pass all given filters; see ``job_filters``."""
    return jobs.where(job_filters(**filters))


def search_total(jobs: DataFrame, **filters) -> DataFrame:
    return search_jobs(jobs, **filters).agg(F.count("*").alias("total"))


def search_page(jobs: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """A page by company and title with the total of all hits in each row."""
    hits = search_jobs(jobs, **filters)
    rows = format_jobs(page(job_projection(hits), ["company", "title", "id"], limit, offset))
    return rows.withColumn("total", hits.agg(F.count("*")).scalar())


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return format_jobs(jobs.where(F.col("id") == job_id))


def jobs_by_ids(jobs: DataFrame, ids: str) -> DataFrame:
    return format_jobs(jobs.where(F.col("id").isin(parse_ids(ids))))


def company_sample(jobs: DataFrame, name: str) -> DataFrame:
    """Ten postings of a company by title."""
    rows = jobs.where(contains_text(F.col("company"), name)).select(
        "id", "title", "department", "seniority", "location", "remote_policy"
    )
    return page(rows, ["title", "id"], 10)


def company_jobs(jobs: DataFrame, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A company's postings by department, seniority and title, with their total."""
    hits = jobs.where(contains_text(F.col("company"), name))
    rows = hits.select(
        "id", "job_id", "title", "department", "seniority", "location", "tech_stack", "skills",
        "remote_policy", "salary_min", "salary_max", "url",
    )
    paged = page(rows, ["department", "seniority", "title", "id"], limit, offset)
    return paged.withColumn("total", hits.agg(F.count("*")).scalar())


def _occurrences(words: str, word: str) -> Column:
    return F.array_size(F.filter(words, lambda w: w == word))


def ranked_search(jobs: DataFrame, query: str, k: int = 20, columns: tuple[str, ...] = ("title", "raw_description")) -> DataFrame:
    """The ``k`` postings that fit a query's words best, with their BM25 score; those without any of them are left out.

    Words are runs of a-z and 0-9 in lower case. Each posting is cut into words where it is read; the statistics over all
    postings, a few numbers per query word, enter as scalar subqueries. Ties go to the smaller id.
    """
    wanted = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    if not wanted:
        raise ValueError("the query holds no word")
    text = F.lower(F.concat_ws(" ", *columns))
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    cut = jobs.select("id", "title", "company", words.alias("_words"))
    counted = cut.select(
        "id", "title", "company", F.array_size("_words").alias("_length"),
        *[_occurrences("_words", word).alias(f"_tf{i}") for i, word in enumerate(wanted)])
    total, length = counted.agg(F.count("*")).scalar(), counted.agg(F.avg("_length")).scalar()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, holders = F.col(f"_tf{i}"), counted.agg(F.count_if(F.col(f"_tf{i}") > 0)).scalar()
        weight = F.log(1 + (total - holders + 0.5) / (holders + 0.5))
        score += weight * tf * (BM25_K + 1) / (tf + BM25_K * (1 - BM25_B + BM25_B * F.col("_length") / length))
    hits = counted.where(reduce(or_, [F.col(f"_tf{i}") > 0 for i in range(len(wanted))]))
    return hits.select("id", "title", "company", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
