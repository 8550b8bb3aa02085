import json


from rolescope.sources import files, payloads, registry


def save(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_scan_scraped_tree(spark, tmp_path):
    save(tmp_path / "lever" / "acme.json", {"company": "Acme Inc", "slug": "other", "jobs": [
        {"id": "1", "title": "A", "location": None, "url": "u", "description": "line\none"}, {"id": "2"}], "scraped_at": "2026-01-02T03:04:05.678901+00:00"})
    save(tmp_path / "ashby" / "be a+c.json", {"jobs": [{"id": "1", "title": "B"}]})
    save(tmp_path / "ashby" / "empty.json", {"company": "empty"})
    rows = files.scan_scraped(spark, str(tmp_path)).orderBy("ats", "job_id").collect()
    assert [(r.ats, r.company, r.job_id, r.title, r.location, r.raw_description, r.pos) for r in rows] == [
        ("ashby", "be a+c", "1", "B", "", "", 0), ("lever", "acme", "1", "A", "", "line\none", 0), ("lever", "acme", "2", "", "", "", 1)]
    assert str(rows[1].scraped_at) == "2026-01-02 03:04:05.678901"


def test_scan_extracted_tree(spark, tmp_path):
    save(tmp_path / "lever" / "acme_batch_0.json", {"company": "acme", "ats": "lever", "batch_id": 0, "jobs": [
        {"job_id": "1", "title": "A", "department": "Sales", "tech_stack": ["x"], "salary_min": 5}, {"error": "No description", "raw": {}}]})
    save(tmp_path / "lever" / "plain.json", {"jobs": [{"job_id": "9", "skills": None}]})
    rows = files.scan_extracted(spark, str(tmp_path)).orderBy("job_id").collect()
    assert [(r.company, r.job_id, r.department, r.tech_stack, r.skills, r.salary_min, r.title) for r in rows] == [
        ("acme", "1", "Sales", ["x"], [], 5, "A"), ("plain", "9", None, [], [], None, "")]
    assert rows[0].parsed_at is not None


def test_scan_profiles_splits_at_first_underscore(spark, tmp_path):
    save(tmp_path / "lever_big_co.json", {"total_jobs": 3, "departments": {"Sales": 2}, "tech_stack": [{"tech": "go", "count": 1}]})
    save(tmp_path / "nounderscore.json", {"total_jobs": 9})
    rows = files.scan_profiles(spark, str(tmp_path)).collect()
    assert [(r.ats, r.company, r.total_jobs, r.jobs_parsed, r.departments, r.top_tech_stack[0].tech, r.hiring_signals) for r in rows] == [
        ("lever", "big_co", 3, 0, {"Sales": 2}, "go", [])]


def test_resumes_decode_ignoring_errors(spark, tmp_path):
    contents = {"a.txt": "größe".encode(), "b.txt": b"caf\xe9 ok \xff\xfe!", "c.txt": "kept �".encode() + b"\xc3", "d.txt": b" \n\t", "e.txt": ("x" * 9000).encode()}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_resumes(spark, str(tmp_path)).collect()}
    assert got == {n: c.decode("utf-8", errors="ignore")[:8000] for n, c in contents.items() if n != "d.txt"}


PAYLOADS = [
    ("greenhouse", "g", {"jobs": [{"id": 7, "title": "T", "location": {"name": "NYC"}, "content": "&lt;p&gt;a&lt;/p&gt;"}, {"title": None, "location": "odd"}]}),
    ("lever", "l", [{"id": "x", "text": "T", "categories": {"location": "SF"}, "hostedUrl": "u", "descriptionPlain": "d"}]),
    ("lever", "l2", {"jobs": [{"id": "x"}]}),
    ("ashby", "a", {"jobs": [{"id": "1", "title": "T", "location": "B", "jobUrl": "u"}, {"id": "2"}]}),
    ("smartrecruiters", "s", {"content": [{"id": "1", "name": "N", "location": {"city": "C"}}, {"id": "2", "name": "M"}]}),
    ("smartrecruiters", "s2", {}),
]


def table(spark, rows):
    data = [(a, s, r if r is None or isinstance(r, str) else json.dumps(r)) for a, s, r in rows]
    return spark.createDataFrame(data, "ats string, slug string, raw string")


def test_payload_mapping(spark):
    detail = {"jobAd": {"sections": {
        "companyDescription": {"title": "Us", "text": "we"}, "jobDescription": {"title": "Job", "text": "<p>do<br>it</p>"},
        "qualifications": {"text": "can"}, "additionalInformation": {"title": "None", "text": ""}}}}
    details = spark.createDataFrame([("s", "1", json.dumps(detail))], "slug string, id string, raw string")
    rows = payloads.parse_payloads(table(spark, PAYLOADS), details).collect()
    got = {(r.slug, r.id): (r.title, r.location, r.url, r.description) for r in rows}
    assert got == {
        ("g", "7"): ("T", "NYC", "https://boards.greenhouse.io/g/jobs/7", "a"),
        ("g", ""): ("", "", "https://boards.greenhouse.io/g/jobs/", ""),
        ("l", "x"): ("T", "SF", "u", "d"),
        ("a", "1"): ("T", "B", "u", ""),
        ("a", "2"): ("", "", "https://jobs.ashbyhq.com/a/2", ""),
        ("s", "1"): ("N", "C", "https://jobs.smartrecruiters.com/s/1", "## Job\n\ndo\nit\n\ncan\n\n## Us\n\nwe"),
        ("s", "2"): ("M", "", "https://jobs.smartrecruiters.com/s/2", ""),
    }


def test_payload_errors_and_counts(spark):
    bad = [("lever", "b1", '[{"id": "1"'), ("ashby", "b2", None), ("workday", "b3", "{}"), (None, "b4", "{}"), ("ashby", "b5", '{"jobs": []} tail')]
    raw = table(spark, PAYLOADS + bad)
    errors = {r.slug: r.error for r in payloads.payload_errors(raw).collect()}
    assert errors == {"b1": "API request failed", "b2": "API request failed", "b3": "Unknown ATS: workday", "b4": "Unknown ATS: ", "b5": "API request failed"}
    counts = {r.slug: (r.jobs_count, r.jobs_with_description) for r in payloads.scrape_counts(raw, payloads.parse_payloads(raw)).collect()}
    assert counts == {"g": (2, 1), "l": (1, 1), "l2": (0, 0), "a": (2, 0), "s": (2, 0), "s2": (0, 0)}


def test_built_in_registry(spark):
    boards = registry.built_in_registry(spark)
    counts = {r.ats: r.companies for r in registry.registry_by_ats(boards).collect()}
    assert counts == {"greenhouse": 104, "ashby": 44, "lever": 13, "smartrecruiters": 12}
    assert registry.registry_scope(boards, 12).select("ats").distinct().count() == 1
    rows = spark.createDataFrame([(0, None, "lever", "a"), (1, "B", None, "b"), (2, "C", "lever", ""), (3, "D", "lever", "d")], boards.schema)
    assert [(r.name, r.slug) for r in registry.registry_scope(rows, 4).collect()] == [("a", "a"), ("D", "d")]
    assert [r.slug for r in registry.registry_scope(rows, 3).collect()] == ["a"]


def test_save_postings_replaces_only_given_companies(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "ats string, slug string, id int"
    files.save_postings(spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("y", "b", 3)], schema), path)
    files.save_postings(spark.createDataFrame([("x", "a", 9)], schema), path)
    assert sorted((r.slug, r.id) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_save_postings_empties_companies_without_rows(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "id int, ats string, slug string"
    rows = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c")], schema)
    files.save_postings(rows, path)
    files.save_postings(rows.where("id = 1"), path, companies=rows.where("ats = 'x'").select("ats", "slug"))
    assert sorted((r.id, r.slug) for r in files.read_postings(spark, path, schema).collect()) == [(1, "a"), (3, "c")]


def test_repeated_details_and_null_payloads(spark):
    from rolescope.sources import payloads

    postings = spark.createDataFrame([("smartrecruiters", "s", "1", "t", "l", "u", None)], "ats string, slug string, id string, title string, location string, url string, description string")
    detail = '{"jobAd": {"sections": {"jobDescription": {"title": "Job", "text": "%s"}}}}'
    details = spark.createDataFrame([("s", "1", detail % "one"), ("s", "1", detail % "two")], "slug string, id string, raw string")
    assert payloads.with_sections(postings, details).count() == 1
    raw = spark.createDataFrame([("lever", "a", "null"), ("lever", "b", "[]"), ("lever", "c", " null\n")], "ats string, slug string, raw string")
    assert sorted(r.slug for r in payloads.payload_errors(raw).collect()) == ["a", "c"]


def test_csv_round_trip(spark, tmp_path):
    from rolescope.sources.files import export_csv, read_csv

    texts = ["plain", 'say "hi"', "a,b", "two\nlines", "back\\slash", 'mix",\n"\\"', "", "ñ你🙂", " padded ", None, "\\0"]
    rows = spark.createDataFrame([(i, t, ["x", None, "y"] if i % 2 else [], {"k": i}) for i, t in enumerate(texts)], "id int, t string, l array<string>, m map<string,int>")
    export_csv(rows, str(tmp_path / "out"))
    got = read_csv(spark, str(tmp_path / "out"), "id int, t string, l string, m string").orderBy("id").collect()
    assert [r.t for r in got] == texts
    assert [r.l or "" for r in got] == ["x|y" if i % 2 else "" for i in range(len(texts))] and got[3].m == '{"k":3}'
