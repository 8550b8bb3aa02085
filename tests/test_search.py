import pytest
from pyspark.sql import functions as F

from rolescope.functions import predicates as P
from rolescope.operators.ranking import deep_page
from rolescope.plans import questions, search
from rolescope.schemas import JOB_FIELDS


@pytest.fixture(scope="module")
def jobs(jobs_from):
    return jobs_from(
        {"title": "Data Engineer", "company": "stripe", "department": "Engineering", "seniority": "Senior", "tech_stack": ["python", None],
         "salary_min": 100, "salary_max": 200, "remote_policy": "Remote", "raw_description": "100% remote_work"},
        {"title": "Seller", "company": "stripe-eu", "department": "Sales", "tech_stack": [], "salary_min": 0, "salary_max": 0},
        {"title": "data analyst", "company": "acme", "tech_stack": ["aws", "python"], "salary_min": None, "salary_max": 150, "skills": ["sql"]},
        {"title": "data analyst", "company": "acme", "tech_stack": None, "raw_description": None},
    )


def ids(rows):
    return sorted(r.id for r in rows.collect())


@pytest.mark.parametrize("filters, expected", [
    ({}, [1, 2, 3, 4]), ({"query": ""}, [1, 2, 3, 4]), ({"query": "DATA"}, [1, 3, 4]), ({"query": "remote"}, [1]),
    ({"query": "100%"}, [1]), ({"query": "d_ta"}, [1, 3, 4]), ({"company": "STRIPE"}, [1, 2]), ({"department": "Sales"}, [2]),
    ({"department": "sales"}, []), ({"tech_stack": ["aws", "go"]}, [3]), ({"tech_stack": []}, [1, 2, 3, 4]),
    ({"salary_min": 150}, [1, 3]), ({"salary_min": 0}, [1, 2, 3, 4]), ({"salary_max": 50}, [2]), ({"salary_min": 1, "salary_max": 100}, [1]),
    ({"company": "stripe", "seniority": "Senior", "remote_policy": "Remote"}, [1]),
])
def test_filters(jobs, filters, expected):
    assert ids(search.search_jobs(jobs, **filters)) == expected
    assert search.search_total(jobs, **filters).first().total == len(expected)


def test_array_predicates(jobs):
    tech = F.col("tech_stack")
    assert ids(jobs.where(P.all_tech(tech, ["aws", "python"]))) == [3]
    assert ids(jobs.where(P.one_tech(tech, "python"))) == [1, 3]
    assert [r[0] for r in jobs.orderBy("id").select(P.any_tech(tech, ["go"])).collect()] == [False, False, False, None]
    assert [r[0] for r in jobs.orderBy("id").select(P.tech_count(tech)).collect()] == [2, None, 2, None]


def test_pages_join_up_to_the_whole(jobs):
    order = ["company", "title", "id"]
    whole = [r.id for r in search.page(jobs, order, 100).collect()]
    parts = [r.id for start in range(0, 4, 2) for r in search.page(jobs, order, 2, start).collect()]
    assert whole == parts == [3, 4, 1, 2]
    deep = [r.id for r in deep_page(jobs, ["company", "id"], 1, 3).collect()]
    assert sorted(deep) == sorted(whole[1:])


def test_search_page_total_and_format(jobs):
    rows = search.search_page(jobs, limit=1, offset=1, query="data").collect()
    assert len(rows) == 1 and rows[0].id == 4 and rows[0].total == 3 and rows[0].tech_stack == [] and rows[0].department is None


def test_format_jobs_fills_absent_columns(spark):
    row = search.format_jobs(spark.createDataFrame([(7, None)], "id int, title string")).first()
    assert list(row.asDict()) == JOB_FIELDS
    assert (row.id, row.title, row.company, row.skills, row.department, row.salary_min) == (7, None, "", [], None, None)


def test_lookups(jobs):
    assert search.job_by_id(jobs, 99).count() == 0
    assert ids(search.jobs_by_ids(jobs, " 1, 3,,99,")) == [1, 3]
    with pytest.raises(ValueError):
        search.jobs_by_ids(jobs, "1, two")


def test_company_jobs_null_last(jobs):
    rows = search.company_jobs(jobs, "%").collect()
    assert [r.department for r in rows] == ["Engineering", "Sales", None, None] and {r.total for r in rows} == {4}


def test_run_sql(spark, jobs):
    assert questions.run_sql(spark, "SELECT count(*) AS n FROM jobs WHERE array_contains(tech_stack, 'python');", jobs).first().n == 2
    assert questions.run_sql(spark, "SELECT id FROM jobs -- all", jobs, padded=True).columns == JOB_FIELDS
    for text in ("DROP VIEW jobs", "SELECT 1) AS a; DROP VIEW jobs --", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(Exception):
            questions.run_sql(spark, text, jobs)


def test_filters_reach_the_scan(spark, jobs, tmp_path):
    """On a stored jobs table equality and range filters are pushed down, and only asked columns are read."""
    path = str(tmp_path / "jobs")
    jobs.write.partitionBy("ats").parquet(path)
    stored = spark.read.parquet(path)
    hits = search.search_jobs(stored, department="Engineering", salary_min=10).where("ats = 'lever'").select("id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(department,Engineering)" in plan and "GreaterThanOrEqual(salary_max,10)" in plan
    assert "PartitionFilters: [isnotnull(ats" in plan and "raw_description" not in plan
