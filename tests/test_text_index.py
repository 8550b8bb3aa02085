import random
import re

import pytest
from pyspark.sql import functions as F

from rolescope.functions.grams import grams, needle_grams
from rolescope.operators import saved_search
from rolescope.operators.keyed_table import KeyedTable
from rolescope.plans import text_index
from rolescope.plans.search import search_jobs

WORDS = ["Senior", "Engineer", "data", "100%", "ÄRZTE", "straße", "naïve", "C++", "a_b", "x" * 40, "你好吗", "\n", "q", "İx"]


def postings(jobs_from, n, seed):
    draw = random.Random(seed)
    return jobs_from(*[{
        "id": i, "job_id": str(i), "title": " ".join(draw.choices(WORDS, k=3)), "company": draw.choice(["acme", "Acme Corp", "zeta_1", "zeta11"]),
        "raw_description": draw.choice([None, "", " ".join(draw.choices(WORDS, k=draw.randint(0, 30)))]), "department": draw.choice([None, "HR", "Sales"]),
        "seniority": draw.choice([None, "Mid"]), "remote_policy": draw.choice(["Remote", None])} for i in range(n)])


NEEDLES = ["engineer", "ENGINEER data", "ärzte", "STRASSE", "straße", "100%", "a_b", "axb", "你好吗", "r\nd", "q", "", "xx", "x" * 30, "sen%eer", "s%d%q", "nothing here", "c++", "İx", "_%", "İX q"]


def test_grams(spark):
    rows = spark.createDataFrame([("abcabc",), ("ab",), (None,), ("AbÇ\nD",), ("🙂🙂🙂🙂",), ("z" * 100_000,)], "t string").select("t", grams(F.col("t")).alias("g")).collect()
    got = [sorted(r.g) for r in rows]
    assert got[:4] == [["abc", "bca", "cab"], [], [], sorted(["abç", "bç\n", "ç\nd"])] and "🙂🙂🙂" in got[4] and got[5] == ["zzz"]
    parts = spark.range(1).select(needle_grams(F.lit("abc%de_fgh\\\\x"))).first()[0]
    assert sorted(parts) == ["abc", "fgh"]


@pytest.fixture(scope="module")
def indexed(spark, jobs_from, tmp_path_factory):
    path = tmp_path_factory.mktemp("index")
    table = KeyedTable.create(postings(jobs_from, 400, 1), str(path / "jobs"), buckets=5)
    return table, text_index.TextIndex.create(table, str(path / "grams"), parts=4)


def test_equal_to_a_scan(indexed):
    table, index = indexed
    jobs = table.read()
    for needle in NEEDLES:
        filters = {"department": "HR"} if len(needle) % 2 else {}
        if needle:
            want = {r.id for r in search_jobs(jobs, query=needle, **filters).collect()}
            assert {r.id for r in text_index.search(table, index, needle, **filters).collect()} == want, needle


def test_reads_the_lists_of_its_grams_only(indexed):
    table, index = indexed
    lists = index.rows(table, ["eng", "dat"])
    plan = lists._jdf.queryExecution().explainString(lists.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: .*part#\d+", plan) and "In(gram, [dat,eng])" in plan
    assert {r.gram for r in lists.collect()} == {"eng", "dat"}
    assert index.candidates(table, ["eng", "zzq"]).count() == 0
    found = text_index.search(table, index, "engineer data")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_changed_rows_are_added(spark, jobs_from, tmp_path):
    table = KeyedTable.create(jobs_from({"id": 1, "job_id": "1", "title": "old words"}, {"id": 2, "job_id": "2", "title": "same"}), str(tmp_path / "jobs"), buckets=3)
    index = text_index.TextIndex.create(table, str(tmp_path / "grams"), parts=2)
    changed = jobs_from({"id": 1, "job_id": "1", "title": "new words"}, {"id": 3, "job_id": "3", "title": "new too"})
    table = table.merge(changed, ["title"], ("id",))
    index.add(table, changed)
    find = lambda needle: {r.id for r in text_index.search(table, index, needle).collect()}
    assert find("old words") == set() and find("words") == {1} and find("new") == {1, 3} and find("same") == {2}


def test_saved_searches_like_single_ones(spark, jobs_from):
    jobs = postings(jobs_from, 300, 2)
    draw, asked = random.Random(4), []
    for i, needle in enumerate([*NEEDLES, *NEEDLES, None]):
        asked.append((i, needle, draw.choice([None, "", "ACME", "zeta_1", "e"]), draw.choice([None, "HR"]), draw.choice(["", "Mid"]), draw.choice([None, "Remote"])))
    asked.append((0, "engineer", None, None, None, None))  # a second search under the same name
    searches = spark.createDataFrame(asked, "search_id int, query string, company string, department string, seniority string, remote_policy string")
    got = sorted(map(tuple, saved_search.matched(jobs, searches).collect()))
    want = sorted((s, r.id) for s, q, c, d, n, p in asked for r in search_jobs(jobs, query=q, company=c, department=d, seniority=n, remote_policy=p).collect())
    assert got == want and len(want) > 300
    assert saved_search.matched(jobs, searches.limit(0)).count() == 0 and saved_search.matched(jobs.limit(0), searches).count() == 0


def test_needles_are_not_looped_over(spark, jobs_from):
    """Thousands of searches make no larger plan than a few."""
    jobs = postings(jobs_from, 50, 3)
    sizes = []
    for n in (3, 3000):
        searches = spark.range(n).selectExpr("id AS search_id", "concat('engineer', id) AS query", *[f"CAST(NULL AS STRING) AS {c}" for c in ("company", "department", "seniority", "remote_policy")])
        sizes.append(len(saved_search.matched(jobs, searches)._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.1 * sizes[0]
