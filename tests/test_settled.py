import json
import random

import pytest

from rolescope.operators.upsert import upsert_scraped
from rolescope.sources.files import postings_of
from rolescope.streaming import landing, settled


def versions(seed, n=60):
    """Documents of a few postings, with equal, missing and broken stamps, in no order."""
    draw = random.Random(seed)
    for i in range(n):
        stamp = draw.choice([None, "soon", *[f"2026-01-{d:02}T00:00:00" for d in range(1, 9)]])
        company = draw.choice(["acme", "acme", "beta", None])
        jobs = [{"id": draw.choice(["1", "2", "3", None]), "title": draw.choice("abc"), "location": "x", "url": "u", "description": draw.choice([None, "d", "e"])}
                for _ in range(draw.randint(0, 3))]
        yield {"company": company, "slug": None, "ats": draw.choice(["lever", "ashby"]), "scraped_at": stamp, "jobs": jobs}


def state(rows):
    return sorted(tuple(map(str, (r.job_id, r.company, r.ats, r.title, r.raw_description, r.scraped_at))) for r in rows.collect())


@pytest.mark.parametrize("seed", [1])
def test_any_order_and_repeats_equal_one_batch(spark, tmp_path, jobs_from, seed):
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    folder.mkdir()
    names = [f"d{i:03}.json" for i in range(60)]
    documents = dict(zip(names, versions(seed)))
    order = random.Random(seed + 10).sample(names, len(names))
    for start in range(0, len(order), 30):
        for name in order[start : start + 30]:
            (folder / name).write_text(json.dumps(documents[name]))
        settled.drain_settled(landing.read_landing(spark, str(folder), files_per_batch=15), log, check)
    jobs = jobs_from({"id": 7, "job_id": "1", "company": "acme", "ats": "lever", "department": "HR"}, {"id": 9, "job_id": "9"})
    files = spark.read.schema(landing.SCRAPED_FILE).json(str(folder))
    batch = postings_of(files.select("ats", "company", landing.F.col("_metadata.file_path").alias("file"), "scraped_at", "jobs")).where("company IS NOT NULL")
    want = state(upsert_scraped(jobs, batch))
    merged = lambda: settled.settled_jobs(jobs, log).where("company IS NOT NULL")
    assert state(merged()) == want and len(want) > 8
    logged, arrived = landing.read_log(spark, log).count(), files.selectExpr("inline(jobs)").count()
    # Repeats of everything, under other names that sort behind, add nothing to the log's content.
    for name in names:
        (folder / f"again-{name}").write_text(json.dumps(documents[name]))
    settled.drain_settled(landing.read_landing(spark, str(folder)), log, check)
    assert logged < arrived and landing.read_log(spark, log).count() < logged + 20
    again = spark.read.schema(landing.SCRAPED_FILE).json(str(folder))
    both = postings_of(again.select("ats", "company", landing.F.col("_metadata.file_path").alias("file"), "scraped_at", "jobs")).where("company IS NOT NULL")
    assert state(merged()) == state(upsert_scraped(jobs, both))


def test_a_replayed_document_adds_no_row(spark, tmp_path):
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    folder.mkdir()
    document = {"company": "acme", "slug": "acme", "ats": "lever", "scraped_at": "2026-01-05T00:00:00", "jobs": [{"id": "1", "title": "t"}]}
    older = document | {"scraped_at": "2026-01-02T00:00:00", "jobs": [{"id": "1", "title": "old"}]}
    between = document | {"scraped_at": "2026-01-03T00:00:00", "jobs": [{"id": "1", "title": "between"}]}
    counts = []
    for name, body in [("a", document), ("b", document), ("c", older), ("d", between), ("e", older), ("f", document)]:
        (folder / f"{name}.json").write_text(json.dumps(body))
        settled.drain_settled(landing.read_landing(spark, str(folder)), log, check)
        counts.append(landing.read_log(spark, log).count())
    assert counts == [1, 1, 2, 2, 2, 2]


def test_dropped_state_changes_nothing(spark, tmp_path, jobs_from):
    """With a limit of a millisecond every batch begins without state: more rows, the same table."""
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    folder.mkdir()
    for name, day, title, job in [("a", 5, "new", "1"), ("b", 2, "x", "2"), ("c", 3, "old", "1"), ("d", 5, "new", "1")]:
        body = {"company": "acme", "slug": "acme", "ats": "lever", "scraped_at": f"2026-01-0{day}T00:00:00", "jobs": [{"id": job, "title": title}]}
        (folder / f"{name}.json").write_text(json.dumps(body))
        settled.drain_settled(landing.read_landing(spark, str(folder)), log, check, limit=1)  # milliseconds
    assert landing.read_log(spark, log).count() >= 3
    got = [(r[0], r[3], r[5]) for r in state(settled.settled_jobs(jobs_from({"job_id": "9"}).limit(0), log))]
    assert got == [("1", "new", "2026-01-03 00:00:00"), ("2", "x", "2026-01-02 00:00:00")]


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """The state is a table that no Python call per posting fills; it remembers its last batch and takes NULL in a key for a value."""
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    folder.mkdir()
    body = {"company": None, "slug": None, "ats": "lever", "scraped_at": "2026-01-05T00:00:00", "jobs": [{"id": "1", "title": "t"}, {"id": "1", "title": "t"}]}
    for name in "ab":
        (folder / f"{name}.json").write_text(json.dumps(body))
        settled.drain_settled(landing.read_landing(spark, str(folder)), log, check)
    state = settled.KeyedTable.open(spark, f"{log}/_state")
    assert state.rows == 1 and [*state.marks.values()] == [1]
    assert landing.read_log(spark, log).count() == 1 + 1  # the first as last and as earliest version
