"""Projections, predicates, lookups and pages over the jobs view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import posting_block
from ..operators.keyed_table import KeyedTable
from ..plans import search, text_index
from ..plans.page_directory import PageDirectory
from ..schemas import JOB_FIELDS
from ..schemas import JOBS as JOBS_SCHEMA
from ..session import new_work_dir
from .registry import register
from .views import jobs_v, table
from .views_sql import using

JOBS = using("jobs_v")
_LISTS = ("tech_stack", "skills", "pain_points")
# The output columns with lists as text, so that both engines hash them alike.
FIELDS_SQL = ", ".join(f"array_to_string({f}, '|') AS {f}" if f in _LISTS else f for f in JOB_FIELDS)
FILLED_SQL = ", ".join(
    f"coalesce(array_to_string({f}, '|'), '') AS {f}" if f in _LISTS else f for f in JOB_FIELDS
)


def flat(rows: DataFrame) -> DataFrame:
    """Lists as text."""
    return rows.withColumns({c: F.array_join(c, "|") for c in _LISTS if c in rows.columns})


@register("job_projection", JOBS + f"SELECT {FIELDS_SQL} FROM jobs_v")
def job_projection(spark, sf):
    return flat(search.job_projection(jobs_v(spark, sf)))


@register("format_jobs", JOBS + f"SELECT {FILLED_SQL.replace('job_summary, url', chr(39) * 2 + ' AS job_summary, url')} FROM jobs_v")
def format_jobs(spark, sf):
    return flat(search.format_jobs(jobs_v(spark, sf).drop("job_summary")))


@register("search_keyword", JOBS + "SELECT id, title FROM jobs_v WHERE title ILIKE '%widget%' OR raw_description ILIKE '%1-urgent%'")
def search_keyword(spark, sf):
    hits = jobs_v(spark, sf).where(P.contains_text(F.col("title"), "widget") | P.contains_text(F.col("raw_description"), "1-urgent"))
    return hits.select("id", "title")


def _indexed(spark, sf, **options):
    work = new_work_dir(spark, "indexed")
    table_ = KeyedTable.create(jobs_v(spark, sf).select(*JOBS_SCHEMA.fieldNames()), f"{work}/jobs", buckets=16)
    return table_, text_index.TextIndex.create(table_, f"{work}/grams", **options)


@register("search_indexed", JOBS + """SELECT 'a' AS search, id, title FROM jobs_v WHERE title ILIKE '%rge RIN%' OR raw_description ILIKE '%rge RIN%'
    UNION ALL SELECT 'b', id, title FROM jobs_v WHERE (title ILIKE '%ing%1-urgent%' OR raw_description ILIKE '%ing%1-urgent%') AND department = 'Sales'
    UNION ALL SELECT 'c', id, title FROM jobs_v WHERE (title ILIKE '%lt%' OR raw_description ILIKE '%lt%') AND seniority = 'Staff'""")
def search_indexed(spark, sf):
    """A keyword, one with a wildcard, and one too short for the index."""
    asked = {"a": {"query": "rge RIN"}, "b": {"query": "ing%1-urgent", "department": "Sales"}, "c": {"query": "lt", "seniority": "Staff"}}
    table_, index = _indexed(spark, sf)
    parts = [text_index.search(table_, index, **filters).select(F.lit(n).alias("search"), "id", "title") for n, filters in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("search_company_indexed", JOBS + "SELECT id, company FROM jobs_v WHERE company ILIKE '%NY_117%'")
def search_company_indexed(spark, sf):
    table_, index = _indexed(spark, sf, columns=("company",), parts=4)
    return text_index.search(table_, index, "NY_117").select("id", "company")


@register("search_summary", JOBS + "SELECT id, job_summary FROM jobs_v WHERE title ILIKE '%company_11%' OR job_summary ILIKE '%company_11%'")
def search_summary(spark, sf):
    hits = search.search_jobs(jobs_v(spark, sf), query="COMPANY_11", query_columns=("title", "job_summary"))
    return hits.select("id", "job_summary")


@register("search_company", JOBS + "SELECT id, company FROM jobs_v WHERE company ILIKE '%ANY_1%'")
def search_company(spark, sf):
    return search.search_jobs(jobs_v(spark, sf), company="ANY_1").select("id", "company")


@register("search_exact", JOBS + "SELECT id FROM jobs_v WHERE department = 'Engineering' AND seniority = 'Senior' AND remote_policy = 'Remote'")
def search_exact(spark, sf):
    return search.search_jobs(
        jobs_v(spark, sf), department="Engineering", seniority="Senior", remote_policy="Remote"
    ).select("id")


@register("search_tech_any", JOBS + "SELECT id FROM jobs_v WHERE list_has_any(tech_stack, ['Golang', 'Rust'])")
def search_tech_any(spark, sf):
    return jobs_v(spark, sf).where(P.any_tech(F.col("tech_stack"), ["Golang", "Rust"])).select("id")


@register("search_tech_all", JOBS + "SELECT id FROM jobs_v WHERE list_has_all(tech_stack, ['AWS', 'Docker'])")
def search_tech_all(spark, sf):
    return jobs_v(spark, sf).where(P.all_tech(F.col("tech_stack"), ["AWS", "Docker"])).select("id")


@register("search_tech_one", JOBS + "SELECT id FROM jobs_v WHERE list_contains(tech_stack, 'k8s')")
def search_tech_one(spark, sf):
    return jobs_v(spark, sf).where(P.one_tech(F.col("tech_stack"), "k8s")).select("id")


@register("search_salary", JOBS + "SELECT id, salary_min, salary_max FROM jobs_v WHERE salary_max >= 150000 AND salary_min <= 200000")
def search_salary(spark, sf):
    return search.search_jobs(jobs_v(spark, sf), salary_min=150000, salary_max=200000).select(
        "id", "salary_min", "salary_max"
    )


@register("search_jobs", JOBS + f"""SELECT {FILLED_SQL}, (
        SELECT count(*) FROM jobs_v WHERE (title ILIKE '%ring%' OR raw_description ILIKE '%ring%') AND department = 'Engineering'
            AND list_has_any(tech_stack, ['AWS', 'k8s']) AND salary_max >= 50000) AS total
    FROM jobs_v WHERE (title ILIKE '%ring%' OR raw_description ILIKE '%ring%') AND department = 'Engineering'
        AND list_has_any(tech_stack, ['AWS', 'k8s']) AND salary_max >= 50000
    ORDER BY company, title, id LIMIT 50 OFFSET 20""")
def search_jobs(spark, sf):
    return flat(search.search_page(
        jobs_v(spark, sf), limit=50, offset=20, query="ring", department="Engineering",
        tech_stack=["AWS", "k8s"], salary_min=50000, salary_max=0,
    ))


@register("search_total", JOBS + "SELECT count(*) AS total FROM jobs_v WHERE remote_policy = 'Hybrid' AND company ILIKE '%company_1%'")
def search_total(spark, sf):
    return search.search_total(jobs_v(spark, sf), remote_policy="Hybrid", company="company_1")


@register("search_deep_page", JOBS + f"""SELECT {FIELDS_SQL} FROM jobs_v
    ORDER BY company, title, id LIMIT 500 OFFSET (SELECT count(*) // 2 FROM jobs_v)""")
def search_deep_page(spark, sf):
    from ..operators.ranking import deep_page

    rows = search.job_projection(jobs_v(spark, sf))
    middle = table(spark, sf, "orders").agg(F.floor(F.count("*") / 2).alias("middle")).scalar()
    return flat(deep_page(rows, ["company", "title", "id"], middle, 500))


@register("search_directory_page", JOBS + f"""SELECT {FIELDS_SQL} FROM jobs_v
    ORDER BY company, title, id LIMIT 700 OFFSET (SELECT count(*) // 3 FROM jobs_v)""")
def search_directory_page(spark, sf):
    """A page of 500 out of a stored order, and the 200 postings that follow its last."""
    order = ("company", "title", "id")
    pages = PageDirectory.create(search.job_projection(jobs_v(spark, sf)), new_work_dir(spark, "pages"), order, rows_per_file=5000)
    first = pages.page(pages.total() // 3, 500)
    last = first.select(*order).orderBy(*[F.desc_nulls_first(c) for c in order]).first()
    return flat(first.unionByName(pages.after(tuple(last), 200)))


@register("company_directory_page", JOBS + """SELECT id, title, department, seniority, count(*) OVER () AS total
    FROM jobs_v WHERE company = (SELECT min(company) FROM jobs_v) ORDER BY department, seniority, title, id LIMIT 20 OFFSET 5""")
def company_directory_page(spark, sf):
    """A page within one company out of a stored order, with the company's total from the directory."""
    jobs = jobs_v(spark, sf).select("company", "department", "seniority", "title", "id")
    pages = PageDirectory.create(jobs, new_work_dir(spark, "pages"), tuple(jobs.columns), rows_per_file=5000)
    company = pages.page(0, 1).first().company
    return pages.page_within((company,), 5, 20).select("id", "title", "department", "seniority", "total")


@register("job_by_id", JOBS + f"SELECT {FILLED_SQL} FROM jobs_v WHERE id = 78")
def job_by_id(spark, sf):
    return flat(search.job_by_id(jobs_v(spark, sf), 78))


@register("jobs_by_ids", JOBS + f"SELECT {FILLED_SQL} FROM jobs_v WHERE id IN (1, 2, 3, 11, 500)")
def jobs_by_ids(spark, sf):
    return flat(search.jobs_by_ids(jobs_v(spark, sf), "1, 2,,3, 11 ,500,"))


@register("tech_count", JOBS + "SELECT id, CAST(nullif(len(tech_stack), 0) AS INT) AS techs FROM jobs_v")
def tech_count(spark, sf):
    return jobs_v(spark, sf).select("id", P.tech_count(F.col("tech_stack")).alias("techs"))


@register("company_sample", JOBS + """SELECT id, title, department, seniority, location, remote_policy FROM jobs_v
    WHERE company ILIKE '%company_7%' ORDER BY title, id LIMIT 10""")
def company_sample(spark, sf):
    return search.company_sample(jobs_v(spark, sf), "company_7")


@register("company_jobs", JOBS + """SELECT id, job_id, title, department, seniority, location, array_to_string(tech_stack, '|') AS tech_stack,
        array_to_string(skills, '|') AS skills, remote_policy, salary_min, salary_max, url,
        (SELECT count(*) FROM jobs_v WHERE company ILIKE '%company_0%') AS total
    FROM jobs_v WHERE company ILIKE '%company_0%'
    ORDER BY department NULLS LAST, seniority NULLS LAST, title, id LIMIT 50 OFFSET 10""")
def company_jobs(spark, sf):
    return flat(search.company_jobs(jobs_v(spark, sf), "company_0", 50, 10))


_BLOCK = """concat(chr(10), '---', chr(10), 'Posting ', id, ': ', title, ', ', company, chr(10), 'Place: ', coalesce(location, 'None'),
    '; remote: ', coalesce(remote_policy, 'None'), chr(10), 'Department: ', coalesce(department, 'None'), '; level: ',
    coalesce(seniority, 'None'), '; years: ', coalesce(CAST(experience_years AS VARCHAR), 'None'), chr(10), 'Technologies: ',
    coalesce(array_to_string(tech_stack, ', '), ''), chr(10), 'Skills: ', coalesce(array_to_string(skills, ', '), ''), chr(10),
    'Summary: ', job_summary, chr(10))"""


@register("job_block", JOBS + f"SELECT id, {_BLOCK} AS block FROM jobs_v")
def job_block(spark, sf):
    return jobs_v(spark, sf).select("id", posting_block({f: F.col(f) for f in JOB_FIELDS}).alias("block"))


_BM25 = " + ".join(
    f"ln(1 + ((SELECT count(*) FROM counted) - (SELECT count(*) FROM counted WHERE tf{i} > 0) + 0.5::DOUBLE) / ((SELECT count(*) FROM counted WHERE tf{i} > 0) + 0.5::DOUBLE))"
    f" * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM counted)))" for i in range(3))


@register("ranked_search", JOBS.rstrip() + f""", cut AS (SELECT id, title, company,
        regexp_extract_all(lower(concat_ws(' ', title, raw_description)), '[a-z0-9]+') AS words FROM jobs_v),
    counted AS (SELECT id, title, company, len(words) AS n, len(list_filter(words, lambda w: w = 'urgent')) AS tf0,
        len(list_filter(words, lambda w: w = 'hot')) AS tf1, len(list_filter(words, lambda w: w = 'plate')) AS tf2 FROM cut)
    SELECT id, title, company, round({_BM25}, 6) AS score FROM counted WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, id LIMIT 20""")
def ranked_search(spark, sf):
    return search.ranked_search(jobs_v(spark, sf), "Urgent: hot-plate")
