import datetime
import random

import pytest

from rolescope.plans import summaries
from rolescope.plans.reports import stats_totals, top_counts


def postings(n, seed, days=6):
    draw = random.Random(seed)
    for i in range(n):
        stamp = draw.choice([None, *[datetime.datetime(2026, 1, d, draw.randint(0, 23)) for d in range(1, days + 1)]])
        yield {"id": i, "job_id": str(i), "company": draw.choice(["acme"] * 4 + ["beta", "zeta"]), "ats": draw.choice(["lever", "ashby"]),
               "title": draw.choice(["", f"title {draw.randint(0, n)}"]), "department": draw.choice([None, "HR", "Sales"]), "seniority": draw.choice([None, "Mid"]),
               "remote_policy": draw.choice(["Remote", None]), "tech_stack": draw.choice([None, [], ["a", "b"], [f"t{draw.randint(0, 50)}", None, "a"]]), "scraped_at": stamp}


@pytest.fixture(scope="module")
def made(spark, jobs_from, tmp_path_factory):
    jobs = jobs_from(*postings(900, 3))
    path = str(tmp_path_factory.mktemp("summaries"))
    summaries.write_days(jobs, path)
    return jobs, path


@pytest.mark.parametrize("span", [(None, None), ("2026-01-02", "2026-01-04"), ("2026-01-05", None), (None, "2026-01-01"), ("2027-01-01", None)])
def test_spans_equal_the_postings(spark, made, span):
    jobs, path = made
    got = summaries.span_totals(summaries.read_daily(spark, path, *span)).first().asDict()
    want = summaries.exact_span(jobs, *span).first().asDict()
    for name in ("postings", "parsed", "companies"):
        assert got[name] == want[name], name
    for name in ("titles", "technologies"):
        assert abs(got[name] - want[name]) <= 4 * summaries.error() * want[name], name


def test_error_is_as_stated(spark, jobs_from, tmp_path):
    """Small sketches of many titles, in several days: estimates stay within four standard errors."""
    jobs = spark.range(60_000).selectExpr(
        "concat('t', id % 40000) AS title", "concat('c', id % 3) AS company", "timestamp_ntz '2026-01-01' + make_interval(0, 0, 0, CAST(id % 5 AS INT)) AS scraped_at",
        "'lever' AS ats", *[f"CAST(NULL AS STRING) AS {c}" for c in summaries.DIMENSIONS], "CAST(NULL AS ARRAY<STRING>) AS tech_stack")
    summaries.write_days(jobs, str(tmp_path), lg_k=10)
    days = summaries.read_daily(spark, str(tmp_path))
    total = summaries.span_totals(days).first()
    assert abs(total.titles - 40_000) <= 4 * summaries.error(10) * 40_000 and total.titles != 40_000
    for r in summaries.span_totals(days, "company").collect():
        want = len({i % 40_000 for i in range(60_000) if f"c{i % 3}" == r.company})
        assert abs(r.titles - want) <= 4 * summaries.error(10) * want


def test_terms_equal_the_reports(spark, made):
    jobs, path = made
    terms = summaries.read_terms(spark, path)
    want = [tuple(r) for r in top_counts(jobs.where("department IS NOT NULL"), "department").collect()]
    assert [tuple(r) for r in summaries.span_terms(terms, "department").collect()] == want
    tech = top_counts(jobs.selectExpr("explode(tech_stack) AS tech").where("tech IS NOT NULL"), "tech", 5)
    assert [tuple(r) for r in summaries.span_terms(terms, "tech_stack", 5).collect()] == [tuple(r) for r in tech.collect()]
    own = top_counts(jobs.where("company = 'beta' AND seniority IS NOT NULL"), "seniority")
    assert [tuple(r) for r in summaries.span_terms(terms, "seniority", company="beta").collect()] == [tuple(r) for r in own.collect()]
    totals = summaries.span_totals(summaries.read_daily(spark, path)).first()
    assert (totals.postings, totals.parsed, totals.companies) == tuple(stats_totals(jobs).first())[:3]


def test_a_day_is_replaced_alone(spark, jobs_from, tmp_path):
    path, jobs = str(tmp_path), jobs_from(*postings(200, 4))
    summaries.write_days(jobs, path)
    before = {f for f in summaries.read_daily(spark, path).inputFiles() if "day=2026-01-03" not in f}
    third = jobs_from({"company": "new", "title": "x", "scraped_at": datetime.datetime(2026, 1, 3)}, {"company": "new", "title": "y", "scraped_at": datetime.datetime(2026, 1, 3)})
    summaries.write_days(third, path)
    after = summaries.read_daily(spark, path).inputFiles()
    assert {f for f in after if "day=2026-01-03" not in f} == before
    day = summaries.span_totals(summaries.read_daily(spark, path, "2026-01-03", "2026-01-03")).first()
    assert (day.postings, day.companies, day.titles, day.technologies) == (2, 1, 2, 0)
    assert "PartitionFilters: [isnotnull(day" in summaries.read_daily(spark, path, "2026-01-03")._jdf.queryExecution().executedPlan().toString()
