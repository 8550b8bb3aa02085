"""The pipeline's stages against brute force, and the registration."""

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from helpers import CLASHING
from pyspark.sql import functions as F
from test_line_dedup import key
from test_simhash import expected as linked

import __spark_entry__ as entry
import corpus_pipeline
from rolescope.llm import decontaminate, queries
from tools.check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, each read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        made = spark.createDataFrame(made.collect(), made.schema)
        out.append((name, docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "line_dedup", "simhash_dedup", "decontamination", "encoding"]
    assert all(s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_quality_keeps_what_labels_call_good(spark, stages):
    _, before, after, _ = stages[0]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if label.get(r.doc_id) == 1]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and set(after) <= set(before) and len(after) < len(before)


def test_lines(stages):
    _, before, after, _ = stages[1]
    holders = defaultdict(set)
    for r in before:
        for line in r.text.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r.doc_id)
    text = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(holders[key(x)]) < 3 or max(holders[key(x)]) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == text and all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_group(stages):
    _, before, after, _ = stages[2]
    groups = linked([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {c for _, _, c in groups} and set(after) <= set(before)


def test_benchmark_passages(spark, stages):
    """Whole items never stay; documents without six tokens in common with an item do."""
    _, before, after, _ = stages[3]
    items = [" ".join(decontaminate.tokens(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 4]) for w in map(str.split, items) for i in range(len(w) - 3)}
    kept = {r.doc_id for r in after}
    for r in before:
        words = decontaminate.tokens(r.text)
        if any(f" {i} " in f" {' '.join(words)} " for i in items):
            assert r.doc_id not in kept
        elif not any(tuple(words[i : i + 4]) in grams for i in range(len(words) - 3)):
            assert r.doc_id in kept


def test_encoding(stages):
    _, before, after, _ = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.ids == library.encode(text[r.doc_id]) + [2] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.ids for r in got} == {r.doc_id: r.ids for r in stages[-1][2]}


def test_nulls_repeats_long_empty_and_clashes(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "one two three four", None, "s", 18), (3, "plain words " * 5000, "en", None, None)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, SCHEMA).withColumns({n: F.lit(v) for n, v in CLASHING.items()})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name != "encoding":
                assert docs.columns == columns, name
                assert all(r["row"] == "mine" for r in docs.collect())
        assert docs.count() == (3 if some else 0)


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare(queries.QUERIES[name], queries.ORACLES[name], spark, connect(SMALL), SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op3_spaced_seeds"}))
def test_query_returns_every_row(spark, name):
    table = "embeddings" if name.startswith("op4_") else "documents"
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
