import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolescope.operators import quality
from rolescope.operators.upsert import latest_by_key, upsert_parsed, upsert_profiles, upsert_scraped
from rolescope.plans.profiles import company_profiles
from rolescope.schemas import KEY

POSTING = "job_id string, company string, ats string, title string, url string, location string, raw_description string, scraped_at timestamp_ntz, file string, pos int"


def day(n):
    return dt.datetime(2026, 1, n)


def posting(job_id, title, at=1, file="f", pos=0, url="u", text="d"):
    return (job_id, "acme", "lever", title, url, "here", text, day(at), file, pos)


@pytest.fixture
def jobs(jobs_from):
    return jobs_from(
        {"id": 5, "job_id": "1", "title": "old", "department": "Sales", "tech_stack": ["go"], "scraped_at": day(1), "raw_description": "r"},
        {"id": 9, "job_id": "2", "title": "stay", "salary_max": 7, "raw_description": "keep"},
    )


def test_scraped_last_wins_and_fields_survive(spark, jobs):
    source = spark.createDataFrame([
        posting("1", "first", 2, pos=0), posting("1", "last", 2, pos=1, url=None, text=None),
        posting("3", "new b", 4, "b"), posting("3", "new a", 4, "a"), posting("3", "newest", 5, "a"),
    ], POSTING)
    merged = upsert_scraped(jobs, source)
    rows = {r.job_id: r for r in merged.collect()}
    assert (rows["1"].title, rows["1"].url, rows["1"].raw_description, rows["1"].department, rows["1"].id) == ("last", None, None, "Sales", 5)
    assert rows["1"].scraped_at == day(1) and rows["2"].title == "stay"
    assert (rows["3"].title, rows["3"].scraped_at, rows["3"].id, rows["3"].department) == ("newest", day(4), 10, None)
    again = upsert_scraped(merged, source)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_parsed_replaces_with_null(spark, jobs):
    columns = ["job_id", "title", "department", "tech_stack", "parsed_at"]
    source = spark.createDataFrame([("1", "t", None, None, day(3)), ("7", "n", "HR", ["a"], day(3))],
                                   "job_id string, title string, department string, tech_stack array<string>, parsed_at timestamp_ntz")
    full = source.select("*", F.lit("acme").alias("company"), F.lit("lever").alias("ats"), F.lit("f").alias("file"), F.lit(0).alias("pos"), *[
        F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns
        if c not in (*columns, "id", "company", "ats", "raw_description", "scraped_at")])
    rows = {r.job_id: r for r in upsert_parsed(jobs, full).collect()}
    assert (rows["1"].department, rows["1"].tech_stack, rows["1"].raw_description, rows["1"].scraped_at) == (None, None, "r", day(1))
    assert (rows["7"].department, rows["7"].raw_description, rows["7"].scraped_at) == ("HR", None, day(3))
    assert rows["2"].salary_max == 7


def test_upsert_into_empty_table(spark, jobs):
    source = spark.createDataFrame([posting("b", "x"), posting("a", "y")], POSTING)
    rows = upsert_scraped(jobs.limit(0), source).collect()
    assert {r.job_id: r.id for r in rows} == {"a": 1, "b": 2}


def test_latest_by_key_on_a_hot_key(spark):
    rows = spark.range(30000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 100 AS STRING) END AS k", "id AS o", "CAST(id * 7 AS STRING) AS v")
    got = {r.k: (r.o, r.v) for r in latest_by_key(rows, ["k"], ["o"]).collect()}
    expected = {}
    for i in range(30000):
        expected["hot" if i % 3 == 0 else str(i % 100)] = (i, str(i * 7))
    assert got == expected


def test_upsert_profiles(jobs, jobs_from):
    day_one, day_two = F.lit("2026-01-01").cast("timestamp_ntz"), F.lit("2026-01-02").cast("timestamp_ntz")
    stored = company_profiles(jobs, day_one)
    fresh = company_profiles(jobs_from({"company": "acme", "department": "HR"}, {"company": "zeta"}), day_two)
    rows = {r.company: r for r in upsert_profiles(stored.union(company_profiles(jobs_from({"company": "solo"}), day_one)), fresh).collect()}
    assert (rows["acme"].total_jobs, rows["acme"].departments, rows["acme"].analyzed_at) == (1, {"HR": 1}, day(2))
    assert rows["solo"].analyzed_at == day(1) and rows["zeta"].jobs_parsed == 0 and rows["zeta"].departments == {}


def test_validate(spark, jobs_from):
    jobs = jobs_from({"job_id": "1"}, {"job_id": "1"}, {"job_id": "2", "title": "t" * 501, "location": "x" * 255}, {"job_id": "3"})
    nulls = jobs.withColumn("title", F.when(F.col("job_id") != "3", F.col("title")))
    checked = quality.validate_jobs(nulls)
    got = sorted((r.job_id, tuple(r.reasons)) for r in checked.collect())
    assert got == [("1", ("duplicate key",)), ("1", ("duplicate key",)), ("2", ("title longer than 500",)), ("3", ("title is null",))]
    assert quality.valid_rows(checked).count() == 0 and quality.quarantined_rows(checked).count() == 4
    assert set(KEY) <= set(quality.valid_rows(checked).columns)


def test_latest_by_key_sends_its_order_once(spark):
    rows = spark.createDataFrame([("k", 1, "f", "a"), ("k", 2, "g", "b"), ("k", None, "h", "c")], "k string, at int, file string, v string")
    latest = latest_by_key(rows, ["k"], ["at", "file"], first=("at",))
    assert [tuple(r) for r in latest.collect()] == [("k", None, "g", "b")]
    assert "max_by" not in latest._jdf.queryExecution().optimizedPlan().toString()


def test_rows_at_rest_are_reduced_without_sending_those_that_come_once(spark):
    """Equal to ``dedupe_postings`` with no, few and many repeated keys, and with missing ones; only few repeats are sent."""
    from rolescope.operators.upsert import dedupe_at_rest, dedupe_postings

    schema = "job_id string, company string, ats string, title string, scraped_at string, file string, pos int"
    once = [(str(i), "acme", "lever", f"t{i}", "2026-01-01", "f", i) for i in range(60)] + [(None, "acme", "lever", "n", "2026-01-01", "f", 0)]
    few = [("7", "acme", "lever", "late", "2026-01-02", "a", 0), (None, "acme", "lever", "n2", None, "f", 0), ("7", "acme", "lever", "tie", "2026-01-02", "a", 0)]
    for rows, sent in ((once, 0), (once + few, 1), (once * 2 + few, 1), ([], 0)):
        postings = spark.createDataFrame(rows, schema)
        reduced = dedupe_at_rest(postings)
        assert reduced.columns == postings.columns
        assert reduced._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == sent
        assert sorted(map(str, reduced.collect())) == sorted(map(str, dedupe_postings(postings).collect()))
