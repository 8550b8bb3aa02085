"""Landing-folder streams over scraped documents."""

from __future__ import annotations

from ..operators.keyed_table import KeyedTable
from ..schemas import JOBS
from ..session import new_work_dir
from ..streaming import landing, settled
from .ingest_queries import SCRAPED_ROWS, scraped_documents
from .registry import register
from .views import jobs_v
from .views_sql import using


def _arrive(spark, sf, work, *version):
    """Put a document per posting into the landing folder. A packed file is read by one task, so files are kept small."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 5000}
    scraped_documents(spark, sf, *version).write.mode("append").options(**packed).json(f"{work}/landing")


@register("stream_drain", using("scraped_v") + SCRAPED_ROWS)
def stream_drain(spark, sf):
    work = new_work_dir(spark, "drain")
    _arrive(spark, sf, work)
    landing.drain(landing.read_landing(spark, f"{work}/landing"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out").drop("file", "pos")


_TWICE = using("jobs_v", "scraped_v") + """SELECT id, ats, company, job_id, title, url, raw_description, scraped_at FROM jobs_v
    UNION ALL SELECT (SELECT max(id) FROM jobs_v) + row_number() OVER (ORDER BY ats, company, job_id), ats, company, job_id, concat('v2 ', title), url,
        description, TIMESTAMP '2026-01-01 00:00:00' FROM scraped_v"""
_WAVES = [("title", "2026-01-01T00:00:00"), ("concat('v2 ', title)", "2026-01-02T00:00:00")]
_KEPT = ["id", "ats", "company", "job_id", "title", "url", "raw_description", "scraped_at"]


@register("stream_upsert", _TWICE)
def stream_upsert(spark, sf):
    """Two arrivals of every document, drained one after the other, merged into the jobs table."""
    work = new_work_dir(spark, "upsert")
    for title, stamp in _WAVES:
        _arrive(spark, sf, work, title, stamp)
        landing.drain_changes(landing.read_landing(spark, f"{work}/landing"), f"{work}/log", f"{work}/checkpoint")
    return landing.merged_jobs(jobs_v(spark, sf).select(*JOBS.fieldNames()), f"{work}/log").select(*_KEPT)


@register("stream_table", _TWICE)
def stream_table(spark, sf):
    """The same arrivals, each merged into a stored table as it is drained."""
    work = new_work_dir(spark, "stream-table")
    KeyedTable.create(jobs_v(spark, sf).select(*JOBS.fieldNames()), f"{work}/jobs", buckets=16)
    for title, stamp in _WAVES:
        _arrive(spark, sf, work, title, stamp)
        landing.drain_into(landing.read_landing(spark, f"{work}/landing"), f"{work}/jobs", f"{work}/checkpoint")
    return KeyedTable.open(spark, f"{work}/jobs").read().select(*_KEPT)


@register("stream_settled", _TWICE)
def stream_settled(spark, sf):
    """The same arrivals, the later one first, and then all of them again: state in the stream settles them before the log."""
    work = new_work_dir(spark, "stream-settled")
    for title, stamp in [*reversed(_WAVES), *_WAVES]:
        _arrive(spark, sf, work, title, stamp)
        settled.drain_settled(landing.read_landing(spark, f"{work}/landing"), f"{work}/log", f"{work}/checkpoint")
    return settled.settled_jobs(jobs_v(spark, sf).select(*JOBS.fieldNames()), f"{work}/log").select(*_KEPT)
