"""Repeated and late documents are settled before they reach the change log, by a state that the stream keeps beside it.

Per posting the state holds when its last version was scraped, where it came from, a hash of its content and the earliest stamp: a few numbers, no text. A row
goes on if it is later than all before it, or if it lowers the earliest stamp; anything else cannot change the merged table. The
log is merged by stamp, not by arrival, so a folder that is read in any order, in any batches, and more than once gives what one batch over all its documents gives.

The state is a ``KeyedTable`` under the log: a micro-batch is reduced to a few numbers per posting, joined with the state's rows, and merged into the buckets that
hold its keys; no posting costs a call of its own. The log's folder of a batch is written first, then the state together with the batch's number, so a batch that is
run again after a crash does the same, or nothing.

State that has not been touched for the time limit counts as dropped, and is removed when a drain ends. Time is that of arrival, the start of a micro-batch, so no document
is ever too late. A document that comes after that is let through again, which costs a row of the log and
changes nothing, but for one case: versions of one stamp and different content, of which the winner was a repeat under another file name.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed_table import KeyedTable
from ..operators.upsert import SCRAPED_COLUMNS, dedupe_postings, upsert_numbered
from ..schemas import KEY
from ..session import stored
from .landing import drain_batches, read_log

MONTH = 30 * 24 * 3600 * 1000
NO_STAMP = -(1 << 63)  # what a missing stamp ranks as: before all others
BUCKETS = 64
_STATE = "key string, last struct<at: long, file: string, pos: int, content: long>, first_at long, arrived long"


def _state(spark: SparkSession, path: str) -> KeyedTable:
    try:
        return KeyedTable.open(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return KeyedTable.create(spark.createDataFrame([], _STATE), path, ["key"], BUCKETS)


def _ranked(postings: DataFrame) -> DataFrame:
    """Postings with the key as one text, also where a part of it is NULL, and what versions of a posting are ordered and told apart by."""
    at = F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(NO_STAMP))
    version = F.struct(at.alias("at"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("pos", F.lit(-1)).alias("pos"), F.xxhash64(*SCRAPED_COLUMNS).alias("content"))
    return postings.withColumns({"key": F.to_json(F.struct(*KEY)), "version": version})


def _settled(ranked: DataFrame, state: DataFrame, now: int, limit: int) -> DataFrame:
    """Per posting of a batch: its new state, and which of its versions go on (``newest``, ``oldest``, NULL if none)."""
    seen = ranked.groupBy("key").agg(F.max("version").alias("top"), F.min("version").alias("low"))
    known = state.where(F.col("arrived") >= now - limit).select("key", "last", "first_at")
    top, low, last = F.col("top"), F.col("low"), F.col("last")
    fresh = last.isNull()
    repeated = (top["at"] == last["at"]) & (top["content"] == last["content"])
    later = fresh | (top > last)
    earlier = fresh | (low["at"] < F.col("first_at"))
    return seen.join(known, "key", "left").select(
        "key", F.when(later, top).otherwise(last).alias("last"), F.when(earlier, low["at"]).otherwise(F.col("first_at")).alias("first_at"),
        F.lit(now).cast("long").alias("arrived"), F.when(fresh | later & ~repeated, top).alias("newest"), F.when(earlier, low).alias("oldest"))


def drain_settled(postings: DataFrame, log: str, checkpoint: str, limit: int = MONTH) -> None:
    """Append the settled rows of all postings that wait in the landing folder (see ``read_landing``) to the change log, then stop. See
    ``drain_changes`` for what a log and its checkpoint owe each other. ``limit``, in milliseconds, is how long the state of an untouched posting is kept."""
    path, names = f"{log}/_state", postings.columns

    def append(batch: DataFrame, number: int, own: str) -> None:
        state = _state(batch.sparkSession, path)
        if state.marks.get(own, -1) >= number:
            return
        ranked = _ranked(batch)
        settled = stored(_settled(ranked, state.read(), int(time.time() * 1000), limit), "settled")
        chosen = settled.where("newest IS NOT NULL OR oldest IS NOT NULL").select("key", "newest", "oldest")
        rows = ranked.join(chosen, "key").where((F.col("version") == F.col("newest")) | (F.col("version") == F.col("oldest")))
        rows.dropDuplicates(["key", "version"]).select(*names).write.mode("overwrite").parquet(f"{log}/batch={number}")
        state.merge(settled, ["last", "first_at", "arrived"], mark=(own, number))

    drain_batches(postings, log, checkpoint, append)
    _forget(postings.sparkSession, path, int(time.time() * 1000) - limit)


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Remove state that has not been touched since, and what older versions of the state have left."""
    state = _state(spark, path)
    expired = state.read().where(F.col("arrived") < before).select("key")
    if not expired.isEmpty():
        state = state.remove(expired)
    state.vacuum()


def settled_jobs(jobs: DataFrame, log: str) -> DataFrame:
    """The jobs table as it was before the log, with the log merged in: the latest stamp wins, the earliest stays as ``scraped_at``."""
    return upsert_numbered(jobs, dedupe_postings(read_log(jobs.sparkSession, log).drop("batch")), SCRAPED_COLUMNS, ("scraped_at",))
