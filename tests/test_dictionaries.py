import random

from pyspark.sql import functions as F

from rolescope.functions.terms import TECH, dictionary_table, normalize_tech_stack
from rolescope.operators.dictionaries import find_terms, normalize_lists, spellings
from rolescope.operators.rules import extract_by_rules

LISTS = "id long, tech_stack array<string>, _names string"


def test_lists_equal_the_literal_form(spark):
    draw = random.Random(2)
    words = [*TECH, "K8S ", " Node.JS", "unknown", "", None, "  ", "ÄÖ", "\tgo\n"]
    rows = [(i, [draw.choice(words) for _ in range(draw.randint(0, 5))], "mine") for i in range(300)] + [(300, None, "mine"), (301, [], "mine"), (302, [None], "mine"), (302, ["K8S "], "mine")]
    rows += [(1000 + i, ["k8s", "hot"], "mine") for i in range(500)]
    table = spark.createDataFrame(rows, LISTS)
    got = normalize_lists(table, "tech_stack", dictionary_table(spark).where("kind = 'tech_stack'"))
    want = table.withColumn("tech_stack", normalize_tech_stack(F.col("tech_stack")))
    assert got.columns == table.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert normalize_lists(table.limit(0), "tech_stack", dictionary_table(spark)).count() == 0


def test_a_dictionary_of_a_million_rows(spark):
    dictionary = spark.range(1_000_000).selectExpr("concat('Term ', id) AS variant", "concat('t', id div 10) AS canonical")
    table = spark.createDataFrame([(1, ["term 17", "TERM 18 ", "term 999999", "term x"], ""), (2, ["term 25"], "")], LISTS)
    got = normalize_lists(table, "tech_stack", dictionary)
    assert {r.id: r.tech_stack for r in got.collect()} == {1: ["t1", "t99999", "term x"], 2: ["t2"]}
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    texts = spark.createDataFrame([(1, "We use term 17, Term 18 and term 5x; term"), (2, None), (3, "nothing")], "id long, text string")
    assert {r.id: r.terms for r in find_terms(texts, ["id"], "text", dictionary).collect()} == {1: ["t1"], 2: [], 3: []}


def test_found_terms_equal_the_literal_form(spark):
    draw = random.Random(5)
    pieces = [*TECH, "and", "we", "apache", "machine", "learning", "google cloud", "of/the", "c++,", "(go)", "node.js."]
    texts = spark.createDataFrame([(i, "t", " ".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))) for i in range(200)] + [(200, "t", None), (201, "t", "word " * 50_000 + "k8s")],
                                  "id long, title string, description string")
    got = {r.id: r.terms for r in find_terms(texts, ["id"], "description", dictionary_table(spark).where("kind = 'tech_stack'")).collect()}
    want = {r.id: r.tech_stack for r in extract_by_rules(texts).collect()}
    assert got == {i: t or [] for i, t in want.items()}


def test_variants_that_repeat(spark):
    rows = spark.createDataFrame([("A ", "y"), ("a", "x"), (None, "z"), ("", "z"), ("b", None)], "variant string, canonical string")
    assert [tuple(r) for r in spellings(rows).collect()] == [("a", "x")]
