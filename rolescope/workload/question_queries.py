"""The named questions, and free SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import no_terms, normalize_tech_stack
from ..plans import questions
from ..plans.profiles import company_profiles
from .registry import register
from .report_queries import PROFILES_SQL
from .terms_sql import TECH_MAP, canonical_list
from .views import jobs_v
from .views_sql import using

JOBS = using("jobs_v")
PROFILES = JOBS.rstrip() + "," + PROFILES_SQL

_SQL = """SELECT department, count(*) AS postings, max(salary_max) AS top_salary FROM jobs
    WHERE title ILIKE '%widget%' AND salary_min IS NOT NULL GROUP BY department;"""


@register("sql_view", JOBS + _SQL.replace("FROM jobs", "FROM jobs_v").rstrip(";"))
def sql_view(spark, sf):
    return questions.run_sql(spark, _SQL, jobs_v(spark, sf))


@register("ask_hiring_engineers", JOBS + "SELECT DISTINCT company FROM jobs_v WHERE department = 'Engineering' ORDER BY company LIMIT 20")
def ask_hiring_engineers(spark, sf):
    return questions.hiring_department(jobs_v(spark, sf))


@register("ask_with_tech", JOBS + "SELECT company, title FROM jobs_v WHERE list_contains(tech_stack, 'k8s') ORDER BY company, title, id LIMIT 20")
def ask_with_tech(spark, sf):
    return questions.with_tech(jobs_v(spark, sf), "k8s")


@register("ask_senior_at", JOBS + """SELECT title, department FROM jobs_v WHERE company ILIKE '%company_0%' AND seniority = 'Senior'
    ORDER BY title, department NULLS LAST, id LIMIT 20""")
def ask_senior_at(spark, sf):
    return questions.level_at(jobs_v(spark, sf), "company_0")


@register("ask_signal", PROFILES + "SELECT company, hiring_signals FROM profiles WHERE hiring_signals LIKE '%aggressive_hiring%'")
def ask_signal(spark, sf):
    answer = questions.with_signal(company_profiles(jobs_v(spark, sf)), "aggressive_hiring")
    return answer.withColumn("hiring_signals", F.array_join("hiring_signals", "|"))


@register("ask_remote_tech", JOBS + """SELECT company, title FROM jobs_v WHERE remote_policy = 'Remote' AND list_contains(tech_stack, 'python3')
    ORDER BY company, title, id LIMIT 20""")
def ask_remote_tech(spark, sf):
    return questions.remote_with_tech(jobs_v(spark, sf), "python3")


@register("ask_top_companies", PROFILES + "SELECT company, total_jobs FROM profiles ORDER BY total_jobs DESC, company, ats LIMIT 10")
def ask_top_companies(spark, sf):
    return questions.top_companies(company_profiles(jobs_v(spark, sf)))


@register("ask_level_pay_place", JOBS + "SELECT id, title FROM jobs_v WHERE seniority = 'Staff' AND salary_max > 200000 AND location ILIKE '%city_3%'")
def ask_level_pay_place(spark, sf):
    return questions.level_pay_place(jobs_v(spark, sf), "Staff", 200000, "city_3").select("id", "title")


@register("ask_remote_senior_eng", JOBS + """SELECT id, title FROM jobs_v WHERE remote_policy = 'Remote' AND seniority = 'Senior'
    AND department = 'Engineering'""")
def ask_remote_senior_eng(spark, sf):
    return questions.remote_level_department(jobs_v(spark, sf)).select("id", "title")


@register("ask_ai_ml", JOBS + f"""SELECT DISTINCT company FROM (SELECT company, title, {canonical_list('terms', TECH_MAP)} AS terms FROM (
        SELECT company, title, list_concat(tech_stack, CASE WHEN list_contains(skills, 'data analytics') THEN ['Machine Learning'] ELSE [] END) AS terms FROM jobs_v))
    WHERE title ILIKE '%machine learning%' OR title ILIKE '%ai/ml%' OR list_has_any(terms, ['ml', 'deep-learning', 'nlp', 'cv', 'llm', 'genai'])""")
def ask_ai_ml(spark, sf):
    extra = F.when(F.array_contains("skills", "data analytics"), F.array(F.lit("Machine Learning"))).otherwise(no_terms())
    jobs = jobs_v(spark, sf)
    return questions.hiring_ai_ml(jobs.withColumn("tech_stack", normalize_tech_stack(F.concat("tech_stack", extra))))


@register("ask_profile_dept", JOBS + """SELECT company, ats, count(*) AS postings FROM jobs_v WHERE department = 'Sales'
    GROUP BY company, ats HAVING count(*) >= 5""")
def ask_profile_dept(spark, sf):
    return questions.profile_department(company_profiles(jobs_v(spark, sf)), "Sales", 5)


@register("ask_level_tech_pay", JOBS + """SELECT id, title, company FROM jobs_v WHERE seniority = 'Senior' AND list_contains(tech_stack, 'python3')
    AND salary_max > 200000""")
def ask_level_tech_pay(spark, sf):
    return questions.level_tech_pay(jobs_v(spark, sf), "Senior", "python3", 200000).select("id", "title", "company")


@register("ask_company_tech", JOBS + "SELECT id, title FROM jobs_v WHERE company ILIKE '%company_2%' AND list_contains(tech_stack, 'Docker')")
def ask_company_tech(spark, sf):
    return questions.company_with_tech(jobs_v(spark, sf), "company_2", "Docker").select("id", "title")
