"""Batches of extracted postings: writing, counting, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTRACTED_POSTING

# Batches of a company that are gathered in one task.
BLOCK = 1000


def batch_documents(extracted: DataFrame) -> DataFrame:
    """One document per ``(ats, company, batch_id)``; a batch holds at most its fixed size of postings."""
    posting = F.struct(*EXTRACTED_POSTING.fieldNames())
    # The postings are sent once, to the task of their company's block, and grouped there; a hot company has many blocks.
    block = F.floor(F.col("batch_id") / BLOCK)
    gathered = extracted.withColumn("_block", block).repartition("ats", "company", "_block")
    return gathered.groupBy("ats", "company", "_block", "batch_id").agg(
        F.array_sort(F.collect_list(posting)).alias("jobs"),
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).cast("int").alias("extracted"),
        F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"),
    ).drop("_block")


def batch_summary(extracted: DataFrame) -> DataFrame:
    """Postings, successes and failures of each batch."""
    return extracted.groupBy("ats", "company", "batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("extracted"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def merge_batches(documents: DataFrame) -> DataFrame:
    """Counters of all batches of a company, summed; works for documents without batches alike. With a stored ``total`` the
    lists themselves are not read."""
    total = F.col("total") if "total" in documents.columns else F.array_size("jobs")
    return documents.groupBy("ats", "company").agg(
        F.sum(total).alias("total_jobs"),
        F.sum("extracted").alias("extracted"),
        F.sum("errors").alias("errors"),
    )


def merged_postings(documents: DataFrame) -> DataFrame:
    """The batches' postings as rows with ``batch_id, pos``: a company's list is never one value in one task."""
    return documents.select(
        "ats", "company", "batch_id", F.posexplode("jobs").alias("pos", "job")
    ).select("ats", F.col("company"), "batch_id", "pos", *[
        F.col(f"job.{n}").alias(n) for n in EXTRACTED_POSTING.fieldNames() if n != "company"
    ])


def write_batches(documents: DataFrame, path: str, gathered: bool = False) -> None:
    """JSON lines, one folder per company, replacing only the companies present. ``gathered`` tells that few tasks hold a company, as
    ``batch_documents`` leaves them, so that the documents need not be sent once more."""
    (
        (documents if gathered else documents.hint("rebalance", F.col("ats"), F.col("company")))
        .write.partitionBy("ats", "company")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .json(path)
    )
