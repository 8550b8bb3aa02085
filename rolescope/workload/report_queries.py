"""Aggregate reports over the jobs, scraped and registry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import json_int, json_text
from ..functions.terms import normalize_tech_stack
from ..plans import profiles, reports, summaries
from ..plans.profiles import company_profiles as build_profiles
from ..schemas import JOBS as JOBS_SCHEMA
from ..session import new_work_dir
from ..sources import registry as boards
from .registry import register
from .terms_sql import TECH_MAP, canonical_list
from .views import jobs_v, registry_v, scraped_v
from .views_sql import using

JOBS, SCRAPED = using("jobs_v"), using("scraped_v")
_SETS = """array_to_string(list_sort(array_agg(DISTINCT department) FILTER (WHERE department IS NOT NULL)), '|') AS departments,
    array_to_string(list_sort(array_agg(DISTINCT seniority) FILTER (WHERE seniority IS NOT NULL)), '|') AS seniorities"""


def _joined(rows, *columns):
    return rows.withColumns({c: F.array_join(c, "|") for c in columns})


@register("stats_totals", JOBS + """SELECT count(*) AS total_jobs, count(department) AS parsed_jobs, count(DISTINCT company) AS total_companies,
    CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(department) / count(*), 1) ELSE 0 END AS parse_rate FROM jobs_v""")
def stats_totals(spark, sf):
    return reports.stats_totals(jobs_v(spark, sf))


@register("stats_by_ats", JOBS + 'SELECT ats, count(*) AS "count" FROM jobs_v GROUP BY ats')
def stats_by_ats(spark, sf):
    return reports.stats_by_ats(jobs_v(spark, sf))


@register("stats_top_departments", JOBS + """SELECT department, count(*) AS "count" FROM jobs_v WHERE department IS NOT NULL
    GROUP BY department ORDER BY 2 DESC, 1 LIMIT 10""")
def stats_top_departments(spark, sf):
    return reports.stats_top_departments(jobs_v(spark, sf))


@register("companies_list", JOBS + f"""SELECT company, ats, count(*) AS job_count, {_SETS} FROM jobs_v
    GROUP BY company, ats HAVING count(*) >= 5 ORDER BY job_count DESC, company, ats LIMIT 100 OFFSET 10""")
def companies_list(spark, sf):
    rows = reports.companies(jobs_v(spark, sf), min_jobs=5, limit=100, offset=10)
    return _joined(rows, "departments", "seniorities")


@register("companies_total", JOBS + """SELECT count(*) AS total FROM (
    SELECT company FROM jobs_v WHERE company ILIKE '%company_1%' GROUP BY company, ats HAVING count(*) >= 10) s""")
def companies_total(spark, sf):
    return reports.companies_total(jobs_v(spark, sf), search="company_1", min_jobs=10)


@register("facet_values", JOBS + """SELECT DISTINCT 'department' AS facet, department AS value FROM jobs_v WHERE department IS NOT NULL
    UNION ALL SELECT DISTINCT 'seniority', seniority FROM jobs_v WHERE seniority IS NOT NULL
    UNION ALL SELECT DISTINCT 'remote_policy', remote_policy FROM jobs_v WHERE remote_policy IS NOT NULL""")
def facet_values(spark, sf):
    return reports.facet_values(jobs_v(spark, sf))


def _tech_sql(k: int, where: str = "") -> str:
    return JOBS + f"""SELECT tech, count(*) AS "count" FROM (SELECT unnest(tech_stack) AS tech FROM jobs_v {where})
        GROUP BY tech ORDER BY 2 DESC, 1 NULLS LAST LIMIT {k}"""


@register("facet_tech", _tech_sql(50))
def facet_tech(spark, sf):
    return reports.facet_tech(jobs_v(spark, sf))


@register("tech_trends", _tech_sql(10))
def tech_trends(spark, sf):
    return reports.tech_trends(jobs_v(spark, sf), 10)


@register("company_detail", JOBS + f"""SELECT company, ats, count(*) AS total_jobs, count(department) AS parsed_jobs, {_SETS}
    FROM jobs_v WHERE company ILIKE '%company_7%' GROUP BY company, ats""")
def company_detail(spark, sf):
    return _joined(reports.company_detail(jobs_v(spark, sf), "company_7"), "departments", "seniorities")


@register("company_tech", _tech_sql(20, "WHERE company ILIKE '%company_3%'"))
def company_tech(spark, sf):
    return reports.company_tech(jobs_v(spark, sf), "company_3")


def _breakdown_sql(column: str) -> str:
    return JOBS + f"""SELECT {column}, count(*) AS "count" FROM jobs_v
        WHERE company ILIKE '%company_0%' AND {column} IS NOT NULL GROUP BY {column}"""


@register("company_departments", _breakdown_sql("department"))
def company_departments(spark, sf):
    return reports.company_breakdown(jobs_v(spark, sf), "company_0", "department")


@register("company_seniorities", _breakdown_sql("seniority"))
def company_seniorities(spark, sf):
    return reports.company_breakdown(jobs_v(spark, sf), "company_0", "seniority")


SIGNALS_SQL = """array_to_string(list_filter([CASE WHEN job_count >= 50 THEN 'aggressive_hiring' END,
    CASE WHEN eng_count >= 10 THEN 'scaling_engineering' END, CASE WHEN sales_count >= 5 THEN 'gtm_expansion' END,
    CASE WHEN senior_count >= 5 THEN 'building_leadership' END], lambda s: s IS NOT NULL), '|')"""
COUNTS_SQL = """count(*) AS job_count, count(*) FILTER (WHERE department = 'Engineering') AS eng_count,
    count(*) FILTER (WHERE department = 'Sales') AS sales_count,
    count(*) FILTER (WHERE seniority IN ('Senior', 'Staff', 'Principal')) AS senior_count"""


@register("hiring_signals", JOBS + f"""SELECT *, {SIGNALS_SQL} AS signals FROM (
    SELECT company, {COUNTS_SQL} FROM jobs_v GROUP BY company HAVING count(*) >= 10 ORDER BY job_count DESC, company LIMIT 50)""")
def hiring_signals(spark, sf):
    return _joined(reports.hiring_signals(jobs_v(spark, sf)), "signals")


# The test spellings hold no AI term, so postings that ask for data analytics get one.
@register("signal_ai_ml", JOBS + f"""SELECT company, count(*) FILTER (WHERE list_has_any({canonical_list('tech_stack', TECH_MAP)},
        ['ml', 'deep-learning', 'nlp', 'cv', 'llm', 'genai'])) AS ai_ml_jobs
    FROM (SELECT company, list_concat(tech_stack, CASE WHEN list_contains(skills, 'data analytics') THEN ['Machine Learning'] ELSE [] END) AS tech_stack FROM jobs_v)
    GROUP BY company HAVING ai_ml_jobs >= 5""")
def signal_ai_ml(spark, sf):
    extra = F.when(F.array_contains("skills", "data analytics"), F.array(F.lit("Machine Learning"))).otherwise(F.array().cast("array<string>"))
    jobs = jobs_v(spark, sf).withColumn("tech_stack", F.concat("tech_stack", extra))
    return reports.signal_ai_ml(jobs, normalize_tech_stack(F.col("tech_stack")))


_RANKED = """array_to_string(list_transform(list_sort(list(struct_pack(m := -n, v := value)) FILTER (WHERE dimension = '{0}' AND place <= 20)),
    lambda e: concat(e.v, ':', -e.m)), '|')"""
_MAPPED = """coalesce(array_to_string(list_sort(list(concat(value, ':', n)) FILTER (WHERE dimension = '{0}')), '|'), '')"""
PROFILES_SQL = f"""
    value_counts AS (
        SELECT ats, company, dimension, value, count(*) AS n FROM (
            SELECT ats, company, 'department' AS dimension, department AS value FROM jobs_v
            UNION ALL SELECT ats, company, 'seniority', seniority FROM jobs_v
            UNION ALL SELECT ats, company, 'tech', unnest(tech_stack) FROM jobs_v
            UNION ALL SELECT ats, company, 'skill', unnest(skills) FROM jobs_v
            UNION ALL SELECT ats, company, 'pain', unnest(pain_points) FROM jobs_v)
        WHERE value IS NOT NULL GROUP BY ALL),
    term_lists AS (
        SELECT ats, company, {_MAPPED.format('department')} AS departments, {_MAPPED.format('seniority')} AS seniority_breakdown,
            coalesce({_RANKED.format('tech')}, '') AS top_tech_stack, coalesce({_RANKED.format('skill')}, '') AS top_skills,
            coalesce({_RANKED.format('pain')}, '') AS top_pain_points
        FROM (SELECT *, row_number() OVER (PARTITION BY ats, company, dimension ORDER BY n DESC, value) AS place FROM value_counts)
        GROUP BY ats, company),
    profiles AS (
        SELECT c.company, c.ats, CAST(job_count AS INT) AS total_jobs, CAST(parsed AS INT) AS jobs_parsed,
            round(100.0::DOUBLE * parsed / job_count, 1) AS parse_rate, coalesce(departments, '') AS departments,
            coalesce(seniority_breakdown, '') AS seniority_breakdown, coalesce(top_tech_stack, '') AS top_tech_stack,
            coalesce(top_skills, '') AS top_skills, coalesce(top_pain_points, '') AS top_pain_points, {SIGNALS_SQL} AS hiring_signals
        FROM (SELECT company, ats, count(department) AS parsed, {COUNTS_SQL} FROM jobs_v GROUP BY company, ats) c
        LEFT JOIN term_lists t ON c.company = t.company AND c.ats = t.ats)
"""


def flat_profiles(profiles):
    """Maps and lists as text, sorted alike in both engines."""

    def entries(name):
        pairs = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        return F.array_join(F.array_sort(pairs), "|")

    def ranked(name, term):
        return F.array_join(F.transform(name, lambda e: F.concat(e[term], F.lit(":"), e["count"].cast("string"))), "|")

    return profiles.withColumns({
        "departments": entries("departments"),
        "seniority_breakdown": entries("seniority_breakdown"),
        "top_tech_stack": ranked("top_tech_stack", "tech"),
        "top_skills": ranked("top_skills", "skill"),
        "top_pain_points": ranked("top_pain_points", "pain_point"),
        "hiring_signals": F.array_join("hiring_signals", "|"),
    })


@register("company_profiles", JOBS.rstrip() + "," + PROFILES_SQL + "SELECT * FROM profiles")
def company_profiles(spark, sf):
    return flat_profiles(build_profiles(jobs_v(spark, sf))).drop("analyzed_at")


@register("profiles_kept_up", JOBS.rstrip() + "," + PROFILES_SQL + "SELECT * FROM profiles")
def profiles_kept_up(spark, sf):
    """Profiles from counts that were made of other postings and then changed by the differences."""
    jobs = jobs_v(spark, sf).select(*JOBS_SCHEMA.fieldNames())
    before = jobs.withColumns({"department": F.expr("nullif(department, 'Sales')"), "skills": F.col("tech_stack"), "company": F.expr("CASE WHEN id % 5 = 0 THEN 'gone' ELSE company END")})
    counts = profiles.create_counts(before, new_work_dir(spark, "counts"), buckets=8)
    return flat_profiles(profiles.profiles_of_counts(profiles.apply_changes(counts, before, jobs))).drop("analyzed_at")


@register("profile_json_get", JOBS + """SELECT company, ats, CAST(nullif(count(*) FILTER (WHERE department = 'Engineering'), 0) AS INT) AS engineering,
    CAST(nullif(count(*) FILTER (WHERE seniority = 'Senior'), 0) AS VARCHAR) AS seniors FROM jobs_v GROUP BY company, ats""")
def profile_json_get(spark, sf):
    stored = build_profiles(jobs_v(spark, sf)).select(
        "company", "ats", F.to_json("departments").alias("departments"), F.to_json("seniority_breakdown").alias("seniority"),
    )
    return stored.select(
        "company", "ats",
        json_int(F.col("departments"), "Engineering").alias("engineering"),
        json_text(F.col("seniority"), "Senior").alias("seniors"),
    )


@register("scrape_summary", SCRAPED + """SELECT CASE WHEN grouping(ats) = 1 THEN 'TOTAL' ELSE ats END AS ats,
        count(DISTINCT concat(ats, '/', company)) AS companies, count(*) AS jobs, count(*) FILTER (WHERE description <> '') AS with_desc,
        round(100.0::DOUBLE * count(*) FILTER (WHERE description <> '') / greatest(count(*), 1), 1) AS rate, CAST(grouping(ats) AS INT) AS is_total
    FROM scraped_v GROUP BY ROLLUP (ats)""")
def scrape_summary(spark, sf):
    return reports.scrape_summary(scraped_v(spark, sf))


REGISTRY = using("registry_v")


@register("registry_scope", REGISTRY + """SELECT coalesce(name, slug) AS name, ats, slug FROM (SELECT * FROM registry_v ORDER BY position LIMIT 50)
    WHERE ats <> '' AND slug <> ''""")
def registry_scope(spark, sf):
    return boards.registry_scope(registry_v(spark, sf), 50)


@register("registry_by_ats", REGISTRY + "SELECT ats, count(*) AS companies FROM registry_v WHERE ats <> '' AND slug <> '' GROUP BY ats")
def registry_by_ats(spark, sf):
    return boards.registry_by_ats(boards.registry_scope(registry_v(spark, sf)))


@register("registry_gaps", using("registry_v", "jobs_v") + """SELECT coalesce(name, slug) AS name, ats, slug FROM registry_v r
    WHERE ats <> '' AND slug <> '' AND NOT EXISTS (SELECT 1 FROM jobs_v j WHERE j.ats = r.ats AND j.company = r.slug)""")
def registry_gaps(spark, sf):
    return boards.registry_gaps(boards.registry_scope(registry_v(spark, sf)), jobs_v(spark, sf)).select("name", "ats", "slug")


@register("facet_counts", JOBS.rstrip() + """, hits AS (SELECT * FROM jobs_v WHERE salary_max >= 100000 AND company ILIKE '%company_1%')
    SELECT 'department' AS facet, department AS value, count(*) AS "count" FROM hits WHERE department IS NOT NULL GROUP BY department
    UNION ALL SELECT 'seniority', seniority, count(*) FROM hits WHERE seniority IS NOT NULL GROUP BY seniority
    UNION ALL SELECT 'remote_policy', remote_policy, count(*) FROM hits WHERE remote_policy IS NOT NULL GROUP BY remote_policy""")
def facet_counts(spark, sf):
    """Facets of the postings that pass a search's filters."""
    return reports.facet_counts(jobs_v(spark, sf), salary_min=100000, company="company_1")


@register("monthly_trends", JOBS + """SELECT *, postings - lag(postings) OVER (PARTITION BY department ORDER BY month) AS change FROM (
    SELECT CAST(date_trunc('month', scraped_at) AS DATE) AS month, department, count(*) AS postings,
        round(CAST(sum(salary_min) AS DOUBLE) / count(salary_min), 2) AS mean_salary_min,
        round(CAST(sum(salary_max) AS DOUBLE) / count(salary_max), 2) AS mean_salary_max FROM jobs_v GROUP BY 1, 2)""")
def monthly_trends(spark, sf):
    return reports.monthly_trends(jobs_v(spark, sf))


_SPAN = "scraped_at >= TIMESTAMP '1995-01-01' AND scraped_at < TIMESTAMP '1997-01-01'"
_MONTHS = ("1995-01-01", "1996-12-31")


@register("summary_span", JOBS + f"""SELECT count(*) AS postings, count(department) AS parsed, count(DISTINCT company) AS companies,
    true AS titles_fit, true AS technologies_fit FROM jobs_v WHERE {_SPAN}""")
def summary_span(spark, sf):
    """Two years out of monthly summaries; the estimates are held against exact distinct numbers, within four standard errors."""
    jobs, path = jobs_v(spark, sf), new_work_dir(spark, "summaries")
    summaries.write_days(jobs, path, unit="month")
    got = summaries.span_totals(summaries.read_daily(spark, path, *_MONTHS))
    exact = summaries.exact_span(jobs, *_MONTHS).selectExpr("titles AS exact_titles", "technologies AS exact_technologies")
    fits = {f"{n}_fit": F.abs(F.col(n) - exact.select(f"exact_{n}").scalar()) <= 4 * summaries.error() * F.col(n) for n in ("titles", "technologies")}
    return got.withColumns(fits).drop("titles", "technologies")


@register("summary_terms", JOBS + f"""SELECT value, count(*) AS "count" FROM (SELECT unnest(tech_stack) AS value FROM jobs_v WHERE {_SPAN})
    WHERE value IS NOT NULL GROUP BY value ORDER BY "count" DESC, value LIMIT 20""")
def summary_terms(spark, sf):
    """The technologies of two years out of monthly counts."""
    path = new_work_dir(spark, "summaries")
    summaries.write_days(jobs_v(spark, sf), path, unit="month")
    return summaries.span_terms(summaries.read_terms(spark, path, *_MONTHS), "tech_stack", 20)


@register("pay_percentiles", JOBS + """SELECT CAST(date_trunc('month', scraped_at) AS DATE) AS month, department, count(*) AS postings,
    round(quantile_cont(salary_min, 0.25), 2) AS p25, round(quantile_cont(salary_min, 0.5), 2) AS p50, round(quantile_cont(salary_min, 0.9), 2) AS p90
    FROM jobs_v WHERE scraped_at IS NOT NULL AND salary_min IS NOT NULL GROUP BY ALL""")
def pay_percentiles(spark, sf):
    return reports.pay_percentiles(jobs_v(spark, sf), (0.25, 0.5, 0.9))
