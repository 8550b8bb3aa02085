"""From raw documents to token ids: quality, repeated lines, near copies, benchmark passages, encoding.

Every stage takes all rows that its predecessor kept and returns the columns of ``documents``, whatever else these are named; the last
returns ids. Rows are carried along as one struct, so that no column of theirs can clash with a stage's own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm import decontaminate, line_dedup, pieces, quality, simhash
from rolescope.llm.common import configure, table
from rolescope.session import stored


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _columns(docs: DataFrame) -> list:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, learned from labels outside fold 0, does not reject."""
    scored = quality.judged(_carried(docs), table(configure(spark), sf_dir, "labels"))
    return scored.where("predicted = 1").select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that three or more documents share, except in the largest id. n_chars follows the new text; a null text
    stays null."""
    rows = _carried(docs)
    applied = line_dedup.LineIndex.empty(configure(spark)).insert(rows).deduplicate(rows)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("text").isNotNull(), F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return applied.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group whose SimHash fingerprints of 3 words are linked by 2 or fewer bits."""
    configure(spark)
    return simhash.one_of_each(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps no benchmark item."""
    return decontaminate.without_leaks(docs, table(configure(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every row: the ids end with the end id and decode to the text."""
    configure(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_documents(docs.select("doc_id", "text"), model, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("encoding", encode),
]
ORACLE_SQL = None  # the classifier, XXH64 and the merges have no DuckDB form; tests/llm checks the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
