"""Payload parsing, file scans, sinks, upserts and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, quality, ranking, upsert
from ..operators.keyed_table import KeyedTable, merge_scraped
from ..plans.profiles import company_profiles
from ..schemas import JOBS, KEY
from ..session import new_work_dir
from ..sources import files, manifest, payloads
from .registry import register
from .report_queries import PROFILES_SQL, flat_profiles
from .search_queries import flat
from .views import changes_v, details_v, jobs_v, payload_v, scraped_v, table
from .views_sql import using


def _feed(name: str) -> None:
    @register(f"ats_{name}", using(f"{name}_v") + f"SELECT * FROM {name}_v")
    def feed(spark, sf):
        return payloads.parse_feed(payload_v(spark, sf), name)


for _name in payloads.FEEDS:
    _feed(_name)


@register("ats_sections", using("sections_v") + "SELECT * FROM sections_v")
def ats_sections(spark, sf):
    listed = payloads.parse_feed(payload_v(spark, sf), "smartrecruiters")
    return payloads.with_sections(listed, details_v(spark, sf))


@register("ats_union", using("records_v") + "SELECT * FROM records_v")
def ats_union(spark, sf):
    return payloads.parse_payloads(payload_v(spark, sf), details_v(spark, sf))


@register("ats_errors", """SELECT ats, concat('board', p_partkey) AS slug,
        CASE WHEN ats = 'homegrown' THEN 'Unknown ATS: homegrown' ELSE 'API request failed' END AS error
    FROM part, (VALUES ('greenhouse'), ('lever'), ('ashby'), ('smartrecruiters'), ('homegrown')) AS a(ats)
    WHERE ats = 'homegrown' OR p_partkey % 13 = 0""")
def ats_errors(spark, sf):
    return payloads.payload_errors(payload_v(spark, sf))


@register("scrape_counts", using("records_v") + """SELECT a.ats, a.slug, count(id) AS jobs_count,
        count(*) FILTER (WHERE description <> '') AS jobs_with_description
    FROM (SELECT ats, concat('board', p_partkey) AS slug FROM part, (VALUES ('greenhouse'), ('lever'), ('ashby'), ('smartrecruiters')) AS v(ats)
        WHERE p_partkey % 13 <> 0) a
    LEFT JOIN records_v r ON a.ats = r.ats AND a.slug = r.slug GROUP BY a.ats, a.slug""")
def scrape_counts(spark, sf):
    raw = payload_v(spark, sf)
    return payloads.scrape_counts(raw, payloads.parse_payloads(raw, details_v(spark, sf)))


def scraped_documents(spark, sf, title: str = "title", stamp: str = "2026-01-01T00:00:00"):
    """One scraped document per posting, as a scraper would save it."""
    return scraped_v(spark, sf).selectExpr(
        "company", "company AS slug", "ats", "1 AS jobs_count",
        f"array(named_struct('id', job_id, 'title', {title}, 'location', location, 'url', url, 'description', description)) AS jobs",
        f"'{stamp}' AS scraped_at",
    )


SCRAPED_ROWS = """SELECT job_id, company, ats, title, url, coalesce(location, '') AS location, description AS raw_description,
    TIMESTAMP '2026-01-01 00:00:00' AS scraped_at FROM scraped_v"""


@register("scan_scraped", using("scraped_v") + SCRAPED_ROWS)
def scan_scraped(spark, sf):
    path = new_work_dir(spark, "scraped")
    documents = scraped_documents(spark, sf).hint("rebalance", F.col("ats"), F.col("company"))
    documents.write.partitionBy("ats", "company").json(path)
    return files.scan_scraped(spark, path, multiline=False).drop("file", "pos")


@register("refresh_tree", using("scraped_v") + SCRAPED_ROWS.replace("title,", "CASE ats WHEN 'lever' THEN concat('v2 ', title) ELSE title END AS title,", 1))
def refresh_tree(spark, sf):
    """A tree scanned in full, then again after one system's companies were scraped anew."""
    work = new_work_dir(spark, "refreshed")
    tree, places = f"{work}/tree", (f"{work}/manifest", f"{work}/out")
    for title, wanted in (("title", "true"), ("concat('v2 ', title)", "ats = 'lever'")):
        documents = scraped_documents(spark, sf, title).where(wanted).hint("rebalance", F.col("ats"), F.col("company"))
        documents.write.partitionBy("ats", "company").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(tree)
        manifest.refresh(spark, tree, *places, multiline=False)
    return manifest.read_refreshed(spark, places[1]).drop("file", "pos")


def extracted_postings(spark, sf):
    """The jobs view as extraction results; what has no department counts as failed."""
    failed = F.when(F.col("department").isNull(), F.lit("No description"))
    rows = jobs_v(spark, sf).withColumn("error", failed).drop("id", "raw_description", "scraped_at", "parsed_at")
    return ranking.batch_numbers(rows)


_BATCHED = using("jobs_v").rstrip() + """, batched AS (SELECT *, CAST((row_number() OVER (PARTITION BY ats, company ORDER BY job_id) - 1) // 10 AS INT)
    AS batch_id FROM jobs_v)
"""


@register("scan_extracted", using("jobs_v") + """SELECT job_id, company, ats, title, url, coalesce(location, '') AS location, department, seniority,
        array_to_string(coalesce(tech_stack, []), '|') AS tech_stack, array_to_string(coalesce(skills, []), '|') AS skills,
        array_to_string(coalesce(pain_points, []), '|') AS pain_points, remote_policy, salary_min, salary_max, experience_years,
        job_summary, TIMESTAMP '2026-01-02 00:00:00' AS parsed_at FROM jobs_v WHERE department IS NOT NULL""")
def scan_extracted(spark, sf):
    path = new_work_dir(spark, "extracted")
    batches.write_batches(batches.batch_documents(extracted_postings(spark, sf)), path, gathered=True)
    stamp = F.lit("2026-01-02 00:00:00").cast("timestamp_ntz")
    return flat(files.scan_extracted(spark, path, stamp, multiline=False).drop("file", "pos"))


@register("scan_profiles", using("jobs_v").rstrip() + "," + PROFILES_SQL + "SELECT * FROM profiles")
def scan_profiles(spark, sf):
    path = new_work_dir(spark, "profiles")
    documents = company_profiles(jobs_v(spark, sf)).select(
        F.concat_ws("_", "ats", "company").alias("profile"), "total_jobs", "jobs_parsed", "parse_rate", "departments",
        F.col("seniority_breakdown").alias("seniority"), F.col("top_tech_stack").alias("tech_stack"),
        F.col("top_skills").alias("skills"), F.col("top_pain_points").alias("pain_points"), "hiring_signals",
    )
    documents.repartition("profile").write.partitionBy("profile").json(path)
    return flat_profiles(files.scan_profiles(spark, path, multiline=False))


@register("sink_roundtrip", using("scraped_v") + """SELECT job_id, company, ats,
    CASE WHEN ats = 'lever' THEN concat('v2 ', title) ELSE title END AS title FROM scraped_v WHERE NOT (ats = 'lever' AND company = 'src3')""")
def sink_roundtrip(spark, sf):
    """Save all companies, save those of one system again, of which one has lost its postings, and read everything back."""
    path = new_work_dir(spark, "postings")
    rows = scraped_v(spark, sf).select("job_id", "company", "ats", "title")
    files.save_postings(rows, path, ("ats", "company"))
    keys = ("ats", "company")
    again = rows.where("ats = 'lever'").withColumn("title", F.concat(F.lit("v2 "), "title"))
    files.save_postings(again.where("company <> 'src3'"), path, keys, companies=again.select(*keys))
    schema = "job_id string, title string, ats string, company string"
    return files.read_postings(spark, path, schema, keys).select("job_id", "company", "ats", "title")


def _scraped_changes(spark, sf):
    return changes_v(spark, sf).select(
        "job_id", "company", "ats", "title", "url", "location", "raw_description", "scraped_at", "file", "pos"
    )


@register("dedupe_latest", using("latest_changes") + """SELECT job_id, company, ats, title, url, location, raw_description,
    first_scraped AS scraped_at, pos FROM latest_changes""")
def dedupe_latest(spark, sf):
    return upsert.dedupe_postings(_scraped_changes(spark, sf)).drop("file")


_SHOWN = ["id", *KEY, "title", "url", "location", "department", "seniority", "tech_stack", "salary_max", "raw_description", "scraped_at"]
_MERGED = using("jobs_v", "latest_changes").rstrip() + """, merged AS (
    SELECT j.id, coalesce(j.ats, c.ats) AS ats, coalesce(j.company, c.company) AS company, coalesce(j.job_id, c.job_id) AS job_id,
        CASE WHEN c.job_id IS NULL THEN j.title ELSE c.title END AS title, CASE WHEN c.job_id IS NULL THEN j.url ELSE c.url END AS url,
        CASE WHEN c.job_id IS NULL THEN j.location ELSE c.location END AS location, j.department, j.seniority,
        array_to_string(j.tech_stack, '|') AS tech_stack, j.salary_max,
        CASE WHEN c.job_id IS NULL THEN j.raw_description ELSE c.raw_description END AS raw_description,
        CASE WHEN j.job_id IS NULL THEN c.first_scraped ELSE j.scraped_at END AS scraped_at
    FROM jobs_v j FULL JOIN latest_changes c ON j.ats = c.ats AND j.company = c.company AND j.job_id = c.job_id)
"""


_NEW_ID = "(SELECT max(id) FROM jobs_v) + row_number() OVER (ORDER BY ats, company, job_id)"
_WITH_IDS = f"""SELECT * FROM merged WHERE id IS NOT NULL
    UNION ALL SELECT {_NEW_ID} AS id, * EXCLUDE (id) FROM merged WHERE id IS NULL"""


@register("upsert_scraped", _MERGED + _WITH_IDS)
def upsert_scraped(spark, sf):
    merged = upsert.upsert_scraped(jobs_v(spark, sf), _scraped_changes(spark, sf))
    return flat(merged.select(*_SHOWN))


@register("table_upsert", _MERGED + _WITH_IDS)
def table_upsert(spark, sf):
    """The same as ``upsert_scraped``, merged into a stored table bucket by bucket."""
    held = KeyedTable.create(jobs_v(spark, sf).select(*JOBS.fieldNames()), new_work_dir(spark, "jobs"), buckets=16)
    return flat(merge_scraped(held, _scraped_changes(spark, sf)).read().select(*_SHOWN))


@register("table_remove", using("jobs_v", "scraped_v") + """SELECT id, ats, company, job_id, title FROM jobs_v
    WHERE (ats, company, job_id) NOT IN (SELECT ats, company, job_id FROM jobs_v WHERE location IS NULL)""")
def table_remove(spark, sf):
    """A stored table without the postings that have no location."""
    jobs = jobs_v(spark, sf).select(*JOBS.fieldNames())
    held = KeyedTable.create(jobs, new_work_dir(spark, "jobs"), buckets=16)
    return held.remove(jobs.where("location IS NULL")).read().select("id", "ats", "company", "job_id", "title")


@register("table_lookup", using("jobs_v") + "SELECT id, ats, company, job_id, title, raw_description FROM jobs_v WHERE job_id IN ('1', '7', '32', '33')")
def table_lookup(spark, sf):
    """Postings of a stored table by key: only the buckets of the keys are opened."""
    jobs = jobs_v(spark, sf).select(*JOBS.fieldNames())
    held = KeyedTable.create(jobs, new_work_dir(spark, "jobs"), buckets=16)
    return held.lookup(jobs.where("job_id IN ('1', '7', '32', '33')")).select("id", "ats", "company", "job_id", "title", "raw_description")


@register("upsert_parsed", using("jobs_v", "latest_changes").rstrip() + """, merged AS (
    SELECT j.id, coalesce(j.ats, c.ats) AS ats, coalesce(j.company, c.company) AS company, coalesce(j.job_id, c.job_id) AS job_id,
        CASE WHEN c.job_id IS NULL THEN j.title ELSE c.title END AS title, CASE WHEN c.job_id IS NULL THEN j.url ELSE c.url END AS url,
        CASE WHEN c.job_id IS NULL THEN j.location ELSE c.location END AS location,
        CASE WHEN c.job_id IS NULL THEN j.department ELSE c.department END AS department,
        CASE WHEN c.job_id IS NULL THEN j.seniority ELSE c.seniority END AS seniority,
        array_to_string(CASE WHEN c.job_id IS NULL THEN j.tech_stack ELSE c.tech_stack END, '|') AS tech_stack,
        CASE WHEN c.job_id IS NULL THEN j.salary_max ELSE c.salary_max END AS salary_max, j.raw_description,
        CASE WHEN j.job_id IS NULL THEN c.scraped_at ELSE j.scraped_at END AS scraped_at
    FROM jobs_v j FULL JOIN latest_changes c ON j.ats = c.ats AND j.company = c.company AND j.job_id = c.job_id)
    """ + _WITH_IDS)
def upsert_parsed(spark, sf):
    extracted = changes_v(spark, sf).drop("raw_description").withColumnRenamed("scraped_at", "parsed_at")
    return flat(upsert.upsert_parsed(jobs_v(spark, sf), extracted).select(*_SHOWN))


@register("assign_ids", _MERGED + """SELECT ats, company, job_id, id FROM merged WHERE id IS NOT NULL
    UNION ALL SELECT ats, company, job_id, (SELECT max(id) FROM jobs_v) + row_number() OVER (ORDER BY ats, company, job_id)
    FROM merged WHERE id IS NULL""")
def assign_ids(spark, sf):
    merged = upsert.upsert_scraped(jobs_v(spark, sf), _scraped_changes(spark, sf))
    return merged.select(*KEY, "id")


@register("upsert_profiles", using("jobs_v", "changes_v").rstrip() + "," + PROFILES_SQL.rstrip() + """,
    changed AS (SELECT company, ats, CAST(count(*) AS INT) AS total_jobs, CAST(count(department) AS INT) AS jobs_parsed FROM changes_v GROUP BY company, ats)
    SELECT coalesce(p.company, c.company) AS company, coalesce(p.ats, c.ats) AS ats,
        CASE WHEN c.ats IS NULL THEN p.total_jobs ELSE c.total_jobs END AS total_jobs,
        CASE WHEN c.ats IS NULL THEN p.jobs_parsed ELSE c.jobs_parsed END AS jobs_parsed,
        CASE WHEN c.ats IS NULL THEN TIMESTAMP '2026-01-01' ELSE TIMESTAMP '2026-01-02' END AS analyzed_at
    FROM profiles p FULL JOIN changed c ON p.company = c.company AND p.ats = c.ats""")
def upsert_profiles(spark, sf):
    stored = company_profiles(jobs_v(spark, sf), F.lit("2026-01-01").cast("timestamp_ntz"))
    fresh = company_profiles(changes_v(spark, sf), F.lit("2026-01-02").cast("timestamp_ntz"))
    merged = upsert.upsert_profiles(stored, fresh)
    return merged.select("company", "ats", "total_jobs", "jobs_parsed", "analyzed_at")


def _lines(text: str) -> list[str]:
    """Postings from order lines that break each rule somewhere; ``text`` is the engine's string type."""
    return [
        f"CASE WHEN l_discount <> 0 THEN CAST(l_orderkey AS {text}) END AS job_id",
        f"concat('company_', CAST(l_suppkey AS {text})) AS company",
        "'lever' AS ats",
        "CASE WHEN l_tax = 0.08 THEN NULL WHEN l_quantity = 50 THEN repeat('long title ', 50) ELSE 'line' END AS title",
        "CASE WHEN l_discount = 0.1 THEN repeat('x', 256) ELSE l_returnflag END AS location",
    ]


@register("validate_jobs", f"""SELECT job_id, company, length(title) AS title_length, array_to_string(list_filter([
        CASE WHEN job_id IS NULL THEN 'job_id is null' END, CASE WHEN title IS NULL THEN 'title is null' END,
        CASE WHEN length(title) > 500 THEN 'title longer than 500' END, CASE WHEN length(location) > 255 THEN 'location longer than 255' END,
        CASE WHEN job_id IS NOT NULL AND repeats > 1 THEN 'duplicate key' END], lambda r: r IS NOT NULL), '|') AS reasons
    FROM (SELECT *, count(*) OVER (PARTITION BY ats, company, job_id) AS repeats FROM (SELECT {', '.join(_lines('VARCHAR'))} FROM lineitem))""")
def validate_jobs(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(*_lines("STRING"))
    for name in ("department", "seniority", "remote_policy"):
        lines = lines.withColumn(name, F.lit(None).cast(JOBS[name].dataType))
    checked = quality.validate_jobs(lines)
    return checked.select("job_id", "company", F.length("title").cast("bigint").alias("title_length"), F.array_join("reasons", "|").alias("reasons"))


@register("extract_batches", _BATCHED + """SELECT ats, company, batch_id, count(*) AS postings, CAST(count(department) AS INT) AS extracted,
    CAST(count(*) - count(department) AS INT) AS errors, array_to_string(list_sort(list(job_id)), '|') AS job_ids FROM batched GROUP BY ats, company, batch_id""")
def extract_batches(spark, sf):
    documents = batches.batch_documents(extracted_postings(spark, sf))
    return documents.select(
        "ats", "company", "batch_id", F.size("jobs").cast("bigint").alias("postings"), "extracted", "errors",
        F.array_join(F.array_sort("jobs.job_id"), "|").alias("job_ids"),
    )


@register("batch_summary", _BATCHED + """SELECT ats, company, batch_id, count(*) AS total, count(department) AS extracted,
    count(*) - count(department) AS errors FROM batched GROUP BY ats, company, batch_id""")
def batch_summary(spark, sf):
    return batches.batch_summary(extracted_postings(spark, sf))


@register("merge_batches", using("jobs_v") + """SELECT ats, company, count(*) AS total_jobs, count(department) AS extracted,
    count(*) - count(department) AS errors FROM jobs_v GROUP BY ats, company""")
def merge_batches(spark, sf):
    return batches.merge_batches(batches.batch_documents(extracted_postings(spark, sf)))


@register("merged_postings", _BATCHED + """SELECT ats, company, batch_id, job_id, title, department,
    CAST(row_number() OVER (PARTITION BY ats, company, batch_id ORDER BY job_id) - 1 AS INT) AS pos FROM batched""")
def merged_postings(spark, sf):
    """The postings of all batches of a company, as one list of rows."""
    rows = batches.merged_postings(batches.batch_documents(extracted_postings(spark, sf)))
    return rows.select("ats", "company", "batch_id", "job_id", "title", "department", "pos")


@register("needs_extraction", using("jobs_v") + """SELECT job_id, company, ats, concat(raw_description, CASE WHEN id % 3 = 0 THEN ' now' ELSE '' END) AS raw_description
    FROM jobs_v WHERE id % 3 = 0 OR parsed_at IS NULL""")
def needs_extraction(spark, sf):
    """All postings scraped again, every third with a changed description."""
    again = jobs_v(spark, sf).withColumns({
        "raw_description": F.expr("concat(raw_description, CASE WHEN id % 3 = 0 THEN ' now' ELSE '' END)"), "file": F.lit("again"), "pos": F.lit(0)})
    found = upsert.needs_extraction(jobs_v(spark, sf), again.select(*KEY, "raw_description", "scraped_at", "file", "pos"))
    return found.select(*KEY, "raw_description")
