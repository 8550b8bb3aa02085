"""Draining a landing folder of scraped documents with Structured Streaming.

The file source keeps track of the files it has read, so each scrape must arrive under a new name.
Every micro-batch appends its postings to a change log; readers merge the log on the fly, and
``compact`` writes a merged table now and then. Work per batch grows with the batch, not with the table,
and nothing that is being read is ever overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..operators.keyed_table import KeyedTable, merge_scraped
from ..operators.upsert import SCRAPED_COLUMNS, dedupe_at_rest, latest_by_key, upsert_numbered
from ..schemas import KEY, SCRAPED_FILE
from ..sources.files import postings_of

_TEXTS = ("job_id", "company", "ats", "title", "url", "location", "raw_description")
# ``batch`` is the folder a micro-batch wrote, so readers prune by it.
_CHANGES = StructType([
    *[StructField(name, StringType()) for name in _TEXTS],
    StructField("scraped_at", TimestampNTZType()),
    StructField("file", StringType()),
    StructField("pos", IntegerType()),
    StructField("batch", LongType()),
])


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of postings from documents written one per line; company and system come from the document."""
    reader = spark.readStream.schema(SCRAPED_FILE).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    documents = reader.json(path).select(
        "ats", F.coalesce("slug", "company").alias("company"),
        F.col("_metadata.file_path").alias("file"), "scraped_at", "jobs",
    )
    return postings_of(documents)


def drain(postings: DataFrame, out: str, checkpoint: str) -> None:
    """Append all postings that wait in the landing folder to a Parquet folder, then stop."""
    query = (
        postings.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_changes(postings: DataFrame, log: str, checkpoint: str) -> None:
    """Append the last write of each key in every micro-batch to the change log, then stop.

    A batch writes its own folder in full, so a batch that is run again replaces its first attempt. A log belongs to one
    checkpoint, whose batch numbers name its folders: with another one, numbers would begin again and replace what the log
    holds, so that is refused.
    """
    drain_rows(postings, log, checkpoint, dedupe_at_rest)


def drain_rows(postings: DataFrame, log: str, checkpoint: str, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Append what ``reduce`` leaves of every micro-batch to the change log, then stop."""
    drain_batches(postings, log, checkpoint, lambda batch, number, _: reduce(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{log}/batch={number}"))


def drain_batches(postings: DataFrame, log: str, checkpoint: str, write: Callable[[DataFrame, int, str], None]) -> None:
    """Hand every micro-batch to ``write``, with its number and its checkpoint's name, which owns the change log from then on; then stop."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's, also after a restart
        owner = _owner(spark, log)
        if owner is None:
            spark.createDataFrame([(own,)], "owner string").coalesce(1).write.json(f"{log}/_owner")
        elif owner != own:
            raise ValueError(f"the change log {log} belongs to another checkpoint")
        write(batch, number, own)

    query = (
        postings.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_into(postings: DataFrame, path: str, checkpoint: str) -> None:
    """Merge all postings that wait in the landing folder into the keyed table at ``path``, then stop.

    Each micro-batch reads and writes only what its keys touch, and is read from its files as often as needed, not stored. The table's manifest records the last batch of each checkpoint
    together with its rows, so a batch that is run again after a crash is not merged twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # the checkpoint's, also after a restart
        table = KeyedTable.open(spark, path)
        if table.marks.get(own, -1) < number:
            merge_scraped(table, batch, (own, number), at_rest=True)

    query = (
        postings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _owner(spark: SparkSession, log: str) -> str | None:
    """The stream that a log's first batch came from."""
    try:
        return spark.read.schema("owner string").json(f"{log}/_owner").first().owner
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_CHANGES).parquet(log)


def merged_jobs(jobs: DataFrame, log: str, after: int = -1) -> DataFrame:
    """The jobs table with the change log merged in; the later arrival wins. New postings get ids on from the highest, which
    stay theirs once ``compact`` has written them. See ``upsert_numbered``.

    ``after`` is the last batch the table already holds; older folders are not read.
    """
    changes = read_log(jobs.sparkSession, log).where(F.col("batch") > after)
    latest = latest_by_key(changes, KEY, ["batch", "scraped_at", "file", "pos"], first=("scraped_at",))
    return upsert_numbered(jobs, latest, SCRAPED_COLUMNS, ("scraped_at",), changes.select(*KEY).distinct())


def compact(jobs: DataFrame, log: str, out: str, after: int = -1) -> None:
    """Write the merged table to a new path, laid out for pruning by system and company."""
    merged = merged_jobs(jobs, log, after).hint("rebalance", F.col("ats"))
    merged.sortWithinPartitions("ats", "company").write.partitionBy("ats").mode("errorifexists").parquet(out)
