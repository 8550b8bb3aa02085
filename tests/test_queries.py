"""Every registered query against its oracle, and what no plan may hold."""

import pytest

import __spark_entry__ as entry
from rolescope.workload import registry
from tools.check_oracles import compare, connect

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 95


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    problem = compare(QUERIES[name], ORACLES[name], spark, duck, SMALL)
    if problem == "no rows":  # too few tables' rows for this filter: an empty result proves nothing
        problem = compare(QUERIES[name], ORACLES[name], spark, connect(LARGER), LARGER)
    assert problem == "", problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_hold_no_cross_join(spark):
    """Also without broadcasts: no pair of tables is joined row by row."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in sorted(set(QUERIES) - {n for n in QUERIES if n.startswith(("scan_", "stream_", "sink_"))}):
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["match_top10_listed", "match_prompts", "company_profiles"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scoped_pairs_are_made_by_broadcast(spark):
    """Candidates are shuffled once, as single rows; the pairs are ranked where they arise."""
    plan = QUERIES["match_top10"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pairs = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in pairs and "Window" in pairs


def test_reports_read_only_what_they_need(spark):
    plan = QUERIES["hiring_signals"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint" in plan
