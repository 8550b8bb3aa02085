from pathlib import Path

import pandas as pd
import pytest

from rolescope.operators.ranking import batch_numbers, deep_page, row_numbers
from rolescope.session import shared_dir, work_tables


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group; NULL is a group of its own."""
    return spark.range(0, 20000, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE CAST(id % 40 AS STRING) END AS g", "(id * 7919) % 20011 AS o", "id")


def test_row_numbers_in_groups(rows):
    got = row_numbers(rows, ["g"], ["o"]).toPandas()
    frame = rows.toPandas()
    frame["g"] = frame["g"].fillna("")
    frame["expected"] = frame.sort_values("o").groupby("g").cumcount() + 1
    merged = got.merge(frame[["id", "expected"]], on="id")
    assert len(merged) == 20000 and (merged.row_number == merged.expected).all()


def test_row_numbers_over_all(rows):
    got = row_numbers(rows, [], ["o"]).orderBy("o").select("row_number").toPandas()
    assert (got.row_number == pd.RangeIndex(1, 20001)).all()


def test_row_numbers_of_nothing(rows):
    assert row_numbers(rows.limit(0), ["g"], ["o"]).count() == 0


def test_no_window_holds_a_group(rows):
    """Rows of the hot group sit in many partitions when they are numbered."""
    numbered = row_numbers(rows, ["g"], ["o"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "sum(_rows" in plan


def test_batches(spark):
    postings = spark.range(95).selectExpr("'lever' AS ats", "CASE WHEN id < 25 THEN 'a' ELSE 'b' END AS company", "lpad(CAST(id AS STRING), 3, '0') AS job_id", "id AS pos")
    by_order = {r.job_id: r.batch_id for r in batch_numbers(postings, 10).collect()}
    assert by_order == {f"{i:03d}": (i if i < 25 else i - 25) // 10 for i in range(95)}
    by_position = batch_numbers(postings, 4, "pos").where("batch_id <> pos div 4")
    assert by_position.count() == 0


def test_deep_page(rows):
    got = [r.o for r in deep_page(rows, ["o"], 15000, 30).orderBy("o").collect()]
    assert got == sorted(r.o for r in rows.select("o").collect())[15000:15030]


def test_work_tables_are_removed(spark, rows):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    with work_tables(spark):
        assert row_numbers(rows.limit(10), [], ["o"]).count() == 10
        assert len(set(shared.iterdir()) - before) == 1
    assert set(shared.iterdir()) == before
    kept = row_numbers(rows.limit(10), [], ["o"])
    assert len(set(shared.iterdir()) - before) == 1 and kept.count() == 10


def test_deep_page_is_ordered(rows):
    plan = deep_page(rows, ["o"], 15000, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Sort [o")
    assert [r.o for r in deep_page(rows, ["o"], 100, 5).collect()] == sorted(r.o for r in rows.select("o").collect())[100:105]
