import pytest
from pyspark.sql import functions as F

from rolescope.plans import profiles, questions, reports


def test_signals_at_their_thresholds(spark):
    rows = spark.createDataFrame([(50, 10, 5, 5), (49, 9, 4, 4), (50, 0, 5, 0)], "job_count int, eng_count int, sales_count int, senior_count int")
    assert [r[0] for r in rows.select(reports.signals()).collect()] == [
        ["aggressive_hiring", "scaling_engineering", "gtm_expansion", "building_leadership"], [], ["aggressive_hiring", "gtm_expansion"]]


def test_null_term_is_a_group_and_ties_break_by_name(jobs_from):
    jobs = jobs_from({"tech_stack": ["b", None]}, {"tech_stack": ["a", None]}, {"tech_stack": []}, {"tech_stack": None})
    assert [tuple(r) for r in reports.tech_trends(jobs, 3).collect()] == [(None, 2), ("a", 1), ("b", 1)]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            reports.tech_trends(jobs, limit)


def test_empty_table(jobs_from):
    empty = jobs_from().limit(0)
    row = reports.stats_totals(empty).first()
    assert tuple(row) == (0, 0, 0, 0.0)
    assert reports.hiring_signals(empty).count() == 0 and reports.companies_total(empty).first().total == 0
    total = reports.scrape_summary(empty, "raw_description").collect()
    assert [(r.ats, r.companies, r.jobs, r.rate) for r in total] in ([("TOTAL", 0, 0, 0.0)], [])


def test_groups_without_values_are_null(jobs_from):
    jobs = jobs_from({"company": "a"}, {"company": "a"}, {"company": "b", "department": "HR", "seniority": "Mid"})
    rows = {r.company: r for r in reports.companies(jobs).collect()}
    assert (rows["a"].job_count, rows["a"].departments, rows["b"].departments, rows["b"].seniorities) == (2, None, ["HR"], ["Mid"])
    assert [r.company for r in reports.companies(jobs, limit=1, offset=1).collect()] == ["b"]
    assert [r.company for r in reports.companies(jobs, search="B", min_jobs=1).collect()] == ["b"]


def test_summary_total_is_the_sum(spark):
    rows = spark.createDataFrame([("x", "a", "t"), ("x", "a", ""), ("x", "b", None), ("y", "a", "t")], "ats string, company string, description string")
    got = [(r.ats, r.companies, r.jobs, r.with_desc, r.rate) for r in reports.scrape_summary(rows).collect()]
    assert got == [("x", 2, 3, 1, 33.3), ("y", 1, 1, 1, 100.0), ("TOTAL", 3, 4, 2, 50.0)]
    known = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("z", "none")], "ats string, company string")
    got = [(r.ats, r.companies, r.jobs, r.rate) for r in reports.scrape_summary(rows, companies=known).collect()]
    assert got == [("x", 2, 3, 33.3), ("y", 1, 1, 100.0), ("z", 1, 0, 0.0), ("TOTAL", 4, 4, 50.0)]


def test_profiles_keep_the_most_frequent_terms(jobs_from):
    jobs = jobs_from(*[{"company": "a", "department": "Sales", "tech_stack": [f"t{i:02d}" for i in range(n, 30)]} for n in range(30)],
                     {"company": "a", "pain_points": [None, "slow"]})
    row = profiles.company_profiles(jobs).first()
    assert (row.total_jobs, row.jobs_parsed, row.parse_rate, row.departments) == (31, 30, 96.8, {"Sales": 30})
    assert [(t.tech, t["count"]) for t in row.top_tech_stack] == [(f"t{i:02d}", i + 1) for i in range(29, 9, -1)]
    assert [(t.pain_point, t["count"]) for t in row.top_pain_points] == [("slow", 1)]
    assert row.seniority_breakdown == {} and row.hiring_signals == ["gtm_expansion"]


def test_questions(jobs_from):
    jobs = jobs_from(
        {"company": "stripe", "department": "Engineering", "seniority": "Senior", "tech_stack": ["python"], "remote_policy": "Remote", "salary_max": 250, "location": "NYC"},
        {"company": "stripe", "department": "Engineering", "title": "Machine Learning Engineer"}, {"company": "b", "tech_stack": ["llm", None]})
    assert [r.company for r in questions.hiring_department(jobs).collect()] == ["stripe"]
    assert questions.remote_with_tech(jobs, "python").count() == 1
    assert questions.level_at(jobs, "STRI").count() == 1
    assert [r.company for r in questions.hiring_ai_ml(jobs).collect()] == ["b", "stripe"]
    assert questions.level_pay_place(jobs, "Senior", 200, "nyc").count() == 1 and questions.level_pay_place(jobs, "Senior", 250, "nyc").count() == 0
    built = profiles.company_profiles(jobs)
    assert [r.company for r in questions.profile_department(built, "Engineering", 2).collect()] == ["stripe"]
    assert [r.total_jobs for r in questions.top_companies(built).collect()] == [2, 1]
    assert reports.signal_ai_ml(jobs, F.col("tech_stack"), 1).first().ai_ml_jobs == 1
