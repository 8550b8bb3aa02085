"""Matching many candidates to postings in one job.

Each candidate is compared with the postings of its scope: the postings it lists, or the first ``limit``
postings that pass its filters. Work grows with the number of listed pairs, or with ``limit`` per
candidate, never with candidates times postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import job_filters
from ..functions.terms import no_terms, normalize_skills, normalize_tech_stack
from ..functions.text import MIN_BLOCK, posting_block, truncate
from ..schemas import JOB_FIELDS, MAX_POSTINGS_BLOCK, MAX_RESUME, SENIORITIES
from ..session import stored
from .saved_search import passed

TOP = 10
QUERY_COLUMNS = ("title", "job_summary")


def parse_ids(text: str) -> list[int]:
    """Ids from "1, 2,,3": blanks are skipped, anything that is not a whole number is an error."""
    return [int(part) for part in text.split(",") if part.strip()]


def listed_ids(candidates: DataFrame, column: str = "job_ids") -> DataFrame:
    """``candidate_id, id`` pairs from a column of comma-separated ids. Parts that are no id are left to ``unlisted_ids``."""
    ids = _id_parts(candidates, column).select("candidate_id", F.col("part").try_cast("bigint").alias("id"))
    return ids.where("id IS NOT NULL").distinct()


def unlisted_ids(candidates: DataFrame, column: str = "job_ids") -> DataFrame:
    """``candidate_id, part`` of listed parts that are no whole number, so that one bad list stops nobody else's match."""
    return _id_parts(candidates, column).where(F.col("part").try_cast("bigint").isNull())


def _id_parts(candidates: DataFrame, column: str) -> DataFrame:
    parts = candidates.select("candidate_id", F.explode(F.split(column, ",")).alias("part"))
    return parts.select("candidate_id", F.btrim("part").alias("part")).where("part <> ''")


def scope_by_filters(
    candidates: DataFrame, jobs: DataFrame, limit: int = 20, query: str | None = None, company: str | None = None
) -> DataFrame:
    """Pairs of each candidate with the first ``limit`` postings (by id) that pass its filters.

    ``want_department`` and ``want_seniority`` of a candidate are its filters, NULL or '' for none; so are ``want_query`` and
    ``want_company``, if there are such columns, beside the ``query`` and ``company`` that hold for all. All
    distinct texts of these are looked up at once, see ``saved_search``.
    Candidates with equal filters share a scope, so postings are ranked once per filter value. The ids
    and then the scopes, ``limit`` rows per filter value, are stored: knowing their size, Spark
    reads the postings' fields and pairs the candidates by broadcast. Should there be too many filter
    values for that, both joins shuffle, and AQE splits a scope that most want. Candidates are spread
    before they fan out, by their id, so that a top-k of the pairs needs no further shuffle.
    """
    eligible = jobs.where(job_filters(query=query, query_columns=QUERY_COLUMNS, company=company))
    own = {f"scope_{c}": F.coalesce(f"want_{c}", F.lit("")) for c in ("query", "company") if f"want_{c}" in candidates.columns}
    if own:
        narrow = stored(eligible.select("id", "department", "seniority", "company", *QUERY_COLUMNS), "eligible")
        searched = {"scope_query": QUERY_COLUMNS, "scope_company": ("company",)}
        wanted = candidates.select(*[c.alias(n) for n, c in own.items()]).distinct()
        eligible = passed(narrow, wanted, {n: searched[n] for n in own})
    ids = stored(_first_ids(eligible, limit, tuple(own)), "scope-ids")
    scopes = stored(ids.join(jobs.select(*JOB_FIELDS), "id"), "scopes")
    asking = _offering(candidates).withColumns({
        "scope_department": F.coalesce("want_department", F.lit("")),
        "scope_seniority": F.coalesce("want_seniority", F.lit("")),
    } | own)
    partitions = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = asking.repartition(partitions, "candidate_id")
    return _pair(spread, scopes, ["scope_department", "scope_seniority", *own])


def _first_ids(jobs: DataFrame, limit: int, own: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` ids of each filter value, with '' for a filter that is not set.

    Ranked on three narrow columns per (department, seniority) first, which Spark also does in the map
    tasks. The first ids of a wider scope are among those of the scopes it holds, so the wider
    ones are ranked from that small table.
    """

    def first(rows: DataFrame, *scope: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*scope).orderBy("id"))
        return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")

    narrow = first(jobs.select("id", "department", "seniority", *own), *own, "department", "seniority")
    scopes = F.explode(F.array(*[
        F.struct(department.alias("scope_department"), seniority.alias("scope_seniority"))
        for department in (F.col("department"), F.lit(""))
        for seniority in (F.col("seniority"), F.lit(""))
    ]))
    widened = narrow.select("id", *own, scopes.alias("scope")).select("id", *own, "scope.*")
    known = widened.where("scope_department IS NOT NULL AND scope_seniority IS NOT NULL")
    return first(known, *own, "scope_department", "scope_seniority")


def scope_by_ids(candidates: DataFrame, jobs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs of each candidate with the postings it lists (``candidate_id, id``); unknown ids drop out.

    Candidates and ids are unique on their own side, so each join adds no rows, and a hot candidate or a hot
    posting is hot in ``listed`` only: AQE splits it, as each join is followed by an exchange on
    another key. The posting join comes last, so that a later top-k per candidate still trims its
    rows in the map tasks; after a join on the candidate there would be no such exchange.
    """
    asking = listed.join(_offering(candidates), "candidate_id")
    return _pair(asking, jobs.select(*JOB_FIELDS), ["id"])


def _offering(candidates: DataFrame) -> DataFrame:
    """Candidates with their canonical terms: to be done before candidates are joined with what they ask for."""
    # A candidate's terms are not sorted into technologies and skills, so each counts under both dictionaries' names.
    return candidates.withColumn("candidate_terms", canonical_terms_of(F.col("terms"), F.col("terms")))


def _pair(candidates: DataFrame, postings: DataFrame, on: list[str]) -> DataFrame:
    """Join both sides; the terms of postings are made canonical before, once per posting."""
    c = candidates.alias("c")
    p = postings.withColumn("required", canonical_terms_of(F.col("tech_stack"), F.col("skills"))).alias("p")
    joined = c.join(p, [F.col(f"c.{k}") == F.col(f"p.{k}") for k in on])
    return joined.select(
        F.col("c.candidate_id"),
        F.col("c.candidate_terms"),
        F.col("c.level").alias("candidate_level"),
        F.col("c.department").alias("candidate_department"),
        F.col("p.required"),
        *[F.col(f"p.{f}").alias(f) for f in JOB_FIELDS],
    )


def canonical_terms_of(tech_stack: Column, skills: Column) -> Column:
    """Canonical technologies and skills together, in order: what a posting asks for, or what a candidate offers."""
    return F.array_sort(F.array_union(normalize_tech_stack(tech_stack), normalize_skills(skills)))


def skill_overlap(pairs: DataFrame) -> DataFrame:
    """Add the required terms the candidate has and those it lacks, each in order."""
    return pairs.withColumns({
        "matching_skills": F.array_intersect("required", "candidate_terms"),
        "missing_skills": F.array_except("required", "candidate_terms"),
    })


def level_rank(level: Column) -> Column:
    """Place of a level on the ladder from 0, NULL if unknown."""
    place = F.array_position(F.array(*[F.lit(s) for s in SENIORITIES]), level)
    return F.when(place > 0, place - 1)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Score 0-100: 40 % skills, 30 % level, 20 % domain, 10 % potential."""
    scored = skill_overlap(pairs)
    needed = F.array_size("required")
    skills = F.when(needed > 0, F.array_size("matching_skills") / needed).otherwise(0.0)
    step = level_rank(F.col("seniority")) - level_rank(F.col("candidate_level"))
    level = F.when(step.isNull(), 0.5).otherwise(1 - F.least(F.abs(step), F.lit(5)) / 5)
    domain = F.when(F.col("candidate_department") == F.col("department"), 1.0).otherwise(0.0)
    potential = F.when(step.isNull(), 0.5).when(step.between(0, 1), 1.0).otherwise(0.0)
    total = 100 * (0.4 * skills + 0.3 * level + 0.2 * domain + 0.1 * potential)
    return scored.withColumn("match_score", F.floor(total + 1e-9).cast("int"))


def top_matches(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` postings of each candidate, ties by id.

    Spark trims each candidate to ``k`` rows in the map tasks, before the shuffle.
    """
    best = Window.partitionBy("candidate_id").orderBy(F.desc_nulls_last("match_score"), "id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def match_band(score: Column) -> Column:
    return F.when(score >= 90, "near-perfect").when(score >= 70, "strong").when(score >= 50, "moderate").otherwise("weak")


def with_jobs(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Give each match its posting's fields; a match whose id is unknown keeps only its own."""
    known = jobs.select(*JOB_FIELDS).withColumnRenamed("job_id", "posting_id")
    arrays = {c: F.when(F.col("posting_id").isNotNull(), F.coalesce(c, no_terms())) for c in ("tech_stack", "skills", "pain_points")}
    joined = matches.withColumnRenamed("job_id", "id").join(known, "id", "left").withColumns(arrays)
    return joined.withColumnRenamed("posting_id", "job_id")


def fill_matches(matches: DataFrame) -> DataFrame:
    """Absent score 0, absent lists empty, absent summary ''."""
    return matches.withColumns({
        "match_score": F.coalesce("match_score", F.lit(0.0)),
        "matching_skills": F.coalesce("matching_skills", no_terms()),
        "missing_skills": F.coalesce("missing_skills", no_terms()),
        "summary": F.coalesce("summary", F.lit("")),
    })


def match_report(matches: DataFrame, jobs: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Top matches with posting fields, and how many postings each candidate was compared with.

    ``analyzed`` is the pair table; it is counted with partial sums before the join.
    """
    counted = analyzed.groupBy("candidate_id").agg(F.count("*").alias("jobs_analyzed"))
    best = top_matches(fill_matches(matches).withColumnRenamed("job_id", "id")).withColumnRenamed("id", "job_id")
    return with_jobs(best, jobs).join(counted, "candidate_id", "left").na.fill(0, ["jobs_analyzed"])


def match_prompts(pairs: DataFrame, resumes: DataFrame) -> DataFrame:
    """One prompt per candidate: its resume and its postings as text blocks, each part cut to its limit.

    Only the first blocks can reach into the cut text, as no block is shorter than its fixed part, so a
    long list is trimmed in the map tasks and the collected list stays small. The count covers all.
    """
    first = MAX_POSTINGS_BLOCK // MIN_BLOCK + 1
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("id"))
    block = posting_block({f: F.col(f) for f in JOB_FIELDS})
    blocks = (
        pairs.withColumn("_place", place)
        .where(F.col("_place") <= first)
        .groupBy("candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct("_place", block.alias("block")))).alias("blocks"))
    )
    counted = pairs.groupBy("candidate_id").agg(F.count("*").alias("job_count"))
    listing = truncate(F.array_join("blocks.block", ""), MAX_POSTINGS_BLOCK)
    return (
        resumes.join(counted, "candidate_id").join(blocks, "candidate_id")
        .select("candidate_id", "job_count", F.concat(
            F.lit("Compare this resume with the postings and score each from 0 to 100: skills 40 %, level 30 %, "
                  "domain 20 %, potential 10 %. Answer with a JSON list of the ten best, highest first, "
                  "with job_id, match_score, matching_skills, missing_skills, summary.\n\nResume:\n"),
            truncate(F.col("text"), MAX_RESUME),
            F.lit("\n\nPostings ("), F.col("job_count").cast("string"), F.lit("):\n"),
            listing,
        ).alias("prompt"))
    )
