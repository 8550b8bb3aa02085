import json

import pytest
from pyspark.errors import StreamingQueryException

from rolescope.sources.files import scan_scraped
from rolescope.streaming import landing


def arrive(folder, name, company, title, ids, stamp):
    folder.mkdir(exist_ok=True)
    document = {"company": company, "slug": company, "ats": "lever", "scraped_at": stamp, "jobs": [
        {"id": i, "title": title, "location": "x", "url": "u", "description": "d"} for i in ids]}
    (folder / name).write_text(json.dumps(document))


def test_drain_equals_batch_and_reads_each_file_once(spark, tmp_path):
    folder, out, check = tmp_path / "in" / "lever", str(tmp_path / "out"), str(tmp_path / "check")
    folder.parent.mkdir()
    arrive(folder, "acme.json", "acme", "one", "12", "2026-01-01T00:00:00")
    stream = lambda: landing.read_landing(spark, str(folder.parent), files_per_batch=1)
    landing.drain(stream(), out, check)
    arrive(folder, "beta.json", "beta", "two", "3", "2026-01-02T00:00:00")
    landing.drain(stream(), out, check)
    landing.drain(stream(), out, check)
    columns = ["job_id", "company", "ats", "title", "raw_description"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert streamed == sorted(map(tuple, scan_scraped(spark, str(folder.parent)).select(*columns).collect())) and len(streamed) == 3


def test_change_log_merges_and_compacts(spark, tmp_path, jobs_from):
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    jobs = jobs_from({"id": 1, "job_id": "1", "department": "HR"}, {"id": 2, "job_id": "old"})
    arrive(folder, "a1.json", "acme", "first", "12", "2026-01-01T00:00:00")
    landing.drain_changes(landing.read_landing(spark, str(folder)), log, check)
    # The later arrival wins, though its stamp is older.
    arrive(folder, "a2.json", "acme", "second", "23", "2025-12-01T00:00:00")
    landing.drain_changes(landing.read_landing(spark, str(folder)), log, check)

    def state(rows):
        return sorted((r.job_id, r.title, r.department, str(r.scraped_at)) for r in rows.collect())

    expected = [("1", "first", "HR", "None"), ("2", "second", None, "2026-01-01 00:00:00"),
                ("3", "second", None, "2025-12-01 00:00:00"), ("old", "title 2", None, "None")]
    assert state(landing.merged_jobs(jobs, log)) == expected
    out = str(tmp_path / "table")
    landing.compact(jobs, log, out)
    stored = spark.read.schema(jobs.schema).parquet(out)
    assert state(stored) == expected and state(landing.merged_jobs(stored, log, after=1)) == expected
    assert state(landing.merged_jobs(stored, log)) == expected


def test_a_log_refuses_a_second_checkpoint(spark, tmp_path, jobs_from):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    arrive(folder, "a1.json", "acme", "first", "1", "2026-01-01T00:00:00")
    stream = lambda: landing.read_landing(spark, str(folder))
    landing.drain_changes(stream(), log, str(tmp_path / "one"))
    with pytest.raises(StreamingQueryException):
        landing.drain_changes(stream(), log, str(tmp_path / "two"))
    arrive(folder, "a2.json", "acme", "second", "2", "2026-01-01T00:00:00")
    landing.drain_changes(stream(), log, str(tmp_path / "one"))
    rows = landing.merged_jobs(jobs_from({"id": 7, "job_id": "9"}), log).collect()
    assert sorted((r.job_id, r.id) for r in rows) == [("1", 8), ("2", 9), ("9", 7)]


def test_the_log_goes_into_the_merge_by_one_shuffle_and_is_not_stored(spark, tmp_path, jobs_from, monkeypatch):
    from rolescope.operators import ranking, upsert

    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    for name, title, ids in (("a1.json", "first", "1223"), ("a2.json", "second", "34")):
        arrive(folder, name, "acme", title, ids, "2026-01-01T00:00:00")
        landing.drain_changes(landing.read_landing(spark, str(folder)), log, check)
    assert landing.read_log(spark, log).where("batch >= 0").count() == 5  # the last write of each key in a batch
    columns, stored = [], ranking.stored
    for module in (ranking, upsert):
        monkeypatch.setattr(module, "stored", lambda df, label: (columns.extend(df.columns), stored(df, label))[1])
    merged = landing.merged_jobs(jobs_from({"id": 7, "job_id": "1", "department": "HR"}), log)
    assert "raw_description" not in columns
    shuffles = [line for line in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) <= 3  # the log's rows, the numbers and the jobs
    rows = sorted((r.job_id, r.title, r.department, r.id) for r in merged.collect())
    assert rows == [("1", "first", "HR", 7), ("2", "first", None, 8), ("3", "second", None, 9), ("4", "second", None, 10)]
