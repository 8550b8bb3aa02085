import json

from pyspark.sql import functions as F

from rolescope.operators import batches, extract, rules

SCHEMA = "job_id string, title string, company string, ats string, location string, url string, description string, batch_id int"


def postings(spark, *descriptions):
    rows = [(str(i), f"t{i}", "acme", "lever", None, "u", d, i // 2) for i, d in enumerate(descriptions)]
    return spark.createDataFrame(rows, SCHEMA)


def test_gate_bounds(spark):
    texts = ["x" * 99, "x" * 100, "x" * 8000, "y" * 8001, "", None]
    rows = extract.gate_description(postings(spark, *texts)).orderBy("job_id").collect()
    assert [r.error for r in rows] == ["No description", None, None, None, "No description", "No description"]
    assert [len(r.description or "") for r in rows] == [99, 100, 8000, 8000, 0, 0]


def test_extract_jobs(spark):
    def model(prompts):
        answers = {"A": json.dumps({"department": "Sales", "tech_stack": ["K8s", "kube"], "skills": None}), "B": "{}", "C": "no", "D": None}
        return [answers[p[p.index("Text:\n") + 6]] for p in prompts]

    texts = [letter * 120 for letter in "ABCD"] + ["A"]
    rows = extract.extract_jobs(postings(spark, *texts), model, parallelism=3).orderBy("job_id").collect()
    failed = "Failed to parse LLM response"
    assert [r.error for r in rows] == [None, failed, failed, failed, "No description"]
    assert (rows[0].department, rows[0].tech_stack, rows[0].skills, rows[0].pain_points) == ("Sales", ["kubernetes"], [], None)
    assert (rows[0].job_id, rows[0].title, rows[0].company, rows[0].url) == ("0", "t0", "acme", "u")
    assert rows[1].department is None and rows[1].tech_stack is None


def test_one_bad_prompt_spares_the_others(spark):
    def model(prompts):
        if any("B" * 120 in p for p in prompts):
            raise ValueError("cannot answer")
        return ['{"department": "HR"}' for _ in prompts]

    rows = extract.extract_jobs(postings(spark, *[c * 120 for c in "ABA"]), model).orderBy("job_id").collect()
    assert [r.department for r in rows] == ["HR", None, "HR"]


def test_retry_waits():
    waits, calls = [], []

    class RateLimitError(Exception):
        pass

    def model(prompts):
        calls.append(len(prompts))
        if len(calls) == 1:
            raise RateLimitError("please retry after 30 seconds")
        if len(calls) < 4:
            raise RateLimitError("slow down")
        return ["ok"] * len(prompts)

    assert extract.retrying(model, sleep=waits.append)(["a", "b"]) == ["ok", "ok"]
    assert waits[0] == 30 and 2 <= waits[1] < 3 and 4 <= waits[2] < 5


def test_retry_gives_up():
    waits = []

    def limited(prompts):
        raise RuntimeError("Rate limit reached")

    assert extract.retrying(limited, sleep=waits.append)(["a", "b"]) == [None, None]
    assert len(waits) == 4


def test_batches_and_summary(spark):
    extracted = extract.extract_jobs(postings(spark, "A" * 120, "x", "A" * 200, "A" * 300, "x"), lambda p: ['{"department": "HR"}'] * len(p))
    documents = batches.batch_documents(extracted)
    summary = {r.batch_id: (r.total, r.extracted, r.errors) for r in batches.batch_summary(extracted).collect()}
    assert summary == {0: (2, 1, 1), 1: (2, 2, 0), 2: (1, 0, 1)}
    merged = batches.merge_batches(documents).first()
    assert (merged.total_jobs, merged.extracted, merged.errors) == (5, 3, 2)
    rows = batches.merged_postings(documents).orderBy("batch_id", "pos").collect()
    assert [(r.batch_id, r.job_id) for r in rows] == [(0, "0"), (0, "1"), (1, "2"), (1, "3"), (2, "4")]


def test_upsert_rows(spark, jobs_from):
    from rolescope.operators.upsert import upsert_parsed

    extracted = extract.extract_jobs(postings(spark, "A" * 120, "x"), lambda p: ['{"department": "HR"}'] * len(p))
    stamp = F.lit("2026-01-01").cast("timestamp_ntz")
    rows = upsert_parsed(jobs_from({"job_id": "0", "raw_description": "r"}), extract.upsert_rows(extracted, stamp)).collect()
    assert [(r.job_id, r.department, r.tech_stack, r.raw_description) for r in rows] == [("0", "HR", [], "r")]


def test_rules(spark):
    text = "We use K8s, Google Cloud Platform and c++. $120,000 - 150000. 5+ years, hybrid."
    row = rules.extract_by_rules(spark.createDataFrame([("Senior VP", text)], "title string, description string")).first()
    assert row.tech_stack == ["cpp", "gcp", "kubernetes"]
    assert (row.salary_min, row.salary_max, row.experience_years, row.remote_policy, row.seniority) == (120000, 150000, 5, "Hybrid", "Senior")


def test_batches_are_gathered_before_they_are_written(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(batches, "BLOCK", 2)
    rows = spark.range(60).selectExpr("CAST(id AS STRING) AS job_id", "concat('c', id % 2) AS company", "'lever' AS ats", "CAST(id div 6 AS INT) AS batch_id")
    rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in batches.EXTRACTED_POSTING if f.name not in rows.columns])
    documents = batches.batch_documents(rows)
    batches.write_batches(documents, str(tmp_path / "b"), gathered=True)
    written = spark.read.json(str(tmp_path / "b"))
    assert sorted(map(tuple, written.select("ats", "company", "batch_id", "total").collect())) == [("lever", f"c{c}", b, 3) for c in range(2) for b in range(10)]
