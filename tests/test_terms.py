import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.functions import terms


def run(spark, lists, normalize):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    return [r[1] for r in rows.select("i", normalize(F.col("v"))).orderBy("i").collect()]


def test_documented_cases(spark):
    tech = [["Node", "node.js", "NodeJS"], ["k8s", "Kubernetes"], None, [], [None], ["a", None], ["\tK8S\n", "", " "]]
    assert run(spark, tech, terms.normalize_tech_stack) == [["nodejs"], ["kubernetes"], [], [], [], ["a"], ["kubernetes"]]
    skills = [["Problem Solving", "problem-solving skills"], ["Machine Learning"]]
    assert run(spark, skills, terms.normalize_skills) == [["problem-solving"], ["machine-learning"]]
    assert run(spark, [["Machine Learning"]], terms.normalize_tech_stack) == [["ml"]]


def test_dictionary_sizes_and_no_chains():
    assert (len(terms.TECH), len(terms.SKILLS)) == (103, 56)
    assert (len(set(terms.TECH.values())), len(set(terms.SKILLS.values()))) == (68, 35)
    for dictionary in (terms.TECH, terms.SKILLS):
        assert all(dictionary.get(c, c) == c for c in dictionary.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*terms.TECH, "Go", "  PY ", "K8S", "unknown", ""]), max_size=6), min_size=1, max_size=20))
def test_twice_is_once(spark, lists):
    once = run(spark, lists, terms.normalize_tech_stack)
    assert run(spark, once, terms.normalize_tech_stack) == once


@pytest.mark.parametrize("spelled, canonical", [
    ("js", "javascript"), ("Node", "nodejs"), ("reactjs", "react"), ("K8S", "kubernetes"), ("  PY ", "python"), ("unknown", "unknown"),
])
def test_single_terms(spark, spelled, canonical):
    assert run(spark, [[spelled]], terms.normalize_tech_stack) == [[canonical]]


def test_canonical_terms(spark):
    rows = terms.canonical_terms(terms.dictionary_table(spark)).collect()
    assert len(rows) == 68 + 35
    assert [r.term for r in rows if r.kind == "skills"] == sorted(set(terms.SKILLS.values()))
