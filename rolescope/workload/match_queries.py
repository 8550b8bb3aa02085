"""Matching all candidates with the postings in their scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import match_errors, parse_matches
from ..operators import matching, saved_search
from ..schemas import JOB_FIELDS, SENIORITIES
from ..sources.files import decode_ignoring_errors
from ..sources.files import resume_gate as gate
from .registry import register
from .search_queries import _BLOCK, flat
from .terms_sql import SKILL_MAP, TECH_MAP, canonical_list
from .views import candidates_v, jobs_v, listed_v, match_replies_v, table
from .views_sql import literal, literals, using
from ..functions.text import WHITESPACE

_PAIR_COLUMNS = """c.candidate_id, c.terms AS candidate_terms, c.level AS candidate_level, c.department AS candidate_department, p.*"""


def _filter_scope(where: str = "true") -> str:
    combinations = " UNION ALL ".join(
        f"SELECT {d} AS scope_department, {s} AS scope_seniority, * FROM jobs_v WHERE {where}"
        for d in ("department", "''") for s in ("seniority", "''")
    )
    return using("jobs_v", "candidates_v").rstrip() + f""", ranked AS (
        SELECT *, row_number() OVER (PARTITION BY scope_department, scope_seniority ORDER BY id) AS place FROM ({combinations})
        WHERE scope_department IS NOT NULL AND scope_seniority IS NOT NULL),
    pairs AS (SELECT {_PAIR_COLUMNS} FROM candidates_v c JOIN ranked p
        ON scope_department = coalesce(want_department, '') AND scope_seniority = coalesce(want_seniority, '') WHERE place <= 20)"""


_LISTED_SCOPE = using("jobs_v", "candidates_v", "listed_v").rstrip() + f""", pairs AS (
    SELECT {_PAIR_COLUMNS} FROM listed_v l JOIN candidates_v c ON l.candidate_id = c.candidate_id JOIN jobs_v p ON l.id = p.id)"""


def _rank(level: str) -> str:
    return f"nullif(list_position({literals(SENIORITIES)}, {level}), 0) - 1"


_SCORED = f""", required_terms AS (
        SELECT *, list_sort(list_distinct(list_concat({canonical_list('tech_stack', TECH_MAP)}, {canonical_list('skills', SKILL_MAP)}))) AS required,
            list_concat({canonical_list('candidate_terms', TECH_MAP)}, {canonical_list('candidate_terms', SKILL_MAP)}) AS own FROM pairs),
    compared AS (
        SELECT *, list_filter(required, lambda r: list_contains(own, r)) AS matching_skills,
            list_filter(required, lambda r: NOT list_contains(own, r)) AS missing_skills,
            {_rank('seniority')} - ({_rank('candidate_level')}) AS step FROM required_terms),
    scored AS (
        SELECT *, CAST(floor(100 * (0.4::DOUBLE * CASE WHEN len(required) > 0 THEN len(matching_skills)::DOUBLE / len(required) ELSE 0 END
            + 0.3::DOUBLE * CASE WHEN step IS NULL THEN 0.5 ELSE 1 - least(abs(step), 5)::DOUBLE / 5 END + 0.2::DOUBLE * CASE WHEN candidate_department = department THEN 1 ELSE 0 END
            + 0.1::DOUBLE * CASE WHEN step IS NULL THEN 0.5 WHEN step BETWEEN 0 AND 1 THEN 1 ELSE 0 END) + 1e-9) AS INT) AS match_score FROM compared),
    best AS (SELECT *, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY match_score DESC, id) AS INT) AS rank FROM scored)
"""
_RESULT = """SELECT candidate_id, rank AS place, id, match_score, array_to_string(matching_skills, '|') AS matching_skills,
    array_to_string(missing_skills, '|') AS missing_skills FROM best WHERE rank <= 10"""


def _result(scored):
    best = matching.top_matches(scored)
    return best.select(
        "candidate_id", "place", "id", "match_score",
        F.array_join("matching_skills", "|").alias("matching_skills"), F.array_join("missing_skills", "|").alias("missing_skills"),
    )


def _filtered(spark, sf, **filters):
    return matching.scope_by_filters(candidates_v(spark, sf), jobs_v(spark, sf), **filters)


def _listed(spark, sf):
    return matching.scope_by_ids(candidates_v(spark, sf), jobs_v(spark, sf), listed_v(spark, sf))


@register("resume_gate", f"SELECT conv_id, turn, substring(text, 1, 8000) AS text FROM conversations WHERE trim(text, {literal(WHITESPACE)}) <> ''")
def resume_gate(spark, sf):
    return gate(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@register("resume_bytes", f"""SELECT conv_id, turn, substring(concat(text, ' end'), 1, 8000) AS text FROM conversations
    WHERE trim(concat(text, ' end'), {literal(WHITESPACE)}) <> ''""")
def resume_bytes(spark, sf):
    """Resumes read as bytes, with some that are not UTF-8 at the front and in the middle."""
    stray = [F.unhex(F.lit(h)) for h in ("FF", "C3", "F09F")]
    content = F.concat(stray[0], F.encode("text", "UTF-8"), stray[1], F.encode(F.lit(" end"), "UTF-8"), stray[2])
    decoded = table(spark, sf, "conversations").select("conv_id", "turn", decode_ignoring_errors(content).alias("text"))
    return gate(decoded).select("conv_id", "turn", "text")


@register("match_scope", _filter_scope("title ILIKE '%ing%' OR job_summary ILIKE '%ing%'") + "SELECT candidate_id, id FROM pairs")
def match_scope(spark, sf):
    return _filtered(spark, sf, query="ing").select("candidate_id", "id")


_OWN_SCOPE = using("jobs_v", "candidates_v").rstrip() + """, asking AS (
        SELECT candidate_id, coalesce(want_department, '') AS d, coalesce(want_seniority, '') AS s, (['ing', 'line 3', ''])[candidate_id % 3 + 1] AS q,
            CASE WHEN candidate_id % 2 = 0 THEN 'company_1' ELSE '' END AS co FROM candidates_v),
    wanted AS (SELECT DISTINCT d, s, q, co FROM asking),
    ranked AS (SELECT d, s, q, co, id, row_number() OVER (PARTITION BY d, s, q, co ORDER BY id) AS place FROM wanted JOIN jobs_v ON
        (d = '' OR department = d) AND (s = '' OR seniority = s) AND (co = '' OR contains(lower(company), co))
        AND (q = '' OR contains(lower(title), q) OR contains(lower(job_summary), q)))
"""


@register("match_scope_own", _OWN_SCOPE + "SELECT candidate_id, id FROM asking JOIN ranked USING (d, s, q, co) WHERE place <= 20")
def match_scope_own(spark, sf):
    """Every candidate with a keyword and a company of its own."""
    asking = candidates_v(spark, sf).withColumns({
        "want_query": F.expr("element_at(array('ing', 'line 3', ''), CAST(candidate_id % 3 + 1 AS INT))"),
        "want_company": F.expr("CASE WHEN candidate_id % 2 = 0 THEN 'company_1' END"),
    })
    return matching.scope_by_filters(asking, jobs_v(spark, sf)).select("candidate_id", "id")


@register("match_scope_each", using("jobs_v", "candidates_v").rstrip() + """, asking AS (
        SELECT candidate_id, coalesce(want_department, '') AS d, coalesce(want_seniority, '') AS s, p_name AS q, concat('COMPANY_', candidate_id % 200) AS co
        FROM candidates_v JOIN part ON p_partkey = candidate_id),
    wanted AS (SELECT DISTINCT d, s, q, co FROM asking),
    ranked AS (SELECT d, s, q, co, id, row_number() OVER (PARTITION BY d, s, q, co ORDER BY id) AS place FROM wanted JOIN jobs_v ON
        (d = '' OR department = d) AND (s = '' OR seniority = s) AND contains(lower(company), lower(co))
        AND (contains(lower(title), lower(q)) OR contains(lower(job_summary), lower(q))))
    SELECT candidate_id, id FROM asking JOIN ranked USING (d, s, q, co) WHERE place <= 20""")
def match_scope_each(spark, sf):
    """Every candidate with two texts of its own: nearly as many searches as candidates."""
    names = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("want_query"))
    asking = candidates_v(spark, sf).join(names, F.col("p_partkey") == F.col("candidate_id")).withColumn(
        "want_company", F.concat(F.lit("COMPANY_"), (F.col("candidate_id") % 200).cast("string")))
    return matching.scope_by_filters(asking, jobs_v(spark, sf)).select("candidate_id", "id")


_SEARCHES = """SELECT s_suppkey AS search_id, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('1-URGENT') WHEN 2 THEN 'g%, priority _-l' WHEN 3 THEN 'g'
        ELSE concat('ing wanted') END AS query, concat('company_', CAST(s_suppkey AS {text})) AS company,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Engineering' ELSE '' END AS department, CAST(NULL AS {text}) AS seniority,
    CASE WHEN s_suppkey % 4 = 0 THEN 'Remote' END AS remote_policy FROM {supplier}"""


@register("saved_searches", using("jobs_v").rstrip() + ", searches AS (" + _SEARCHES.format(text="VARCHAR", supplier="supplier") + """)
    SELECT search_id, id FROM searches s JOIN jobs_v j ON (coalesce(s.query, '') = '' OR j.title ILIKE concat('%', s.query, '%') OR j.raw_description ILIKE concat('%', s.query, '%'))
        AND j.company ILIKE concat('%', s.company, '%') AND (s.department = '' OR j.department = s.department)
        AND (s.remote_policy IS NULL OR j.remote_policy = s.remote_policy)""")
def saved_searches(spark, sf):
    """The saved search of every supplier against all postings; some hold wildcards or are short."""
    searches = spark.sql(_SEARCHES.format(text="STRING", supplier="{supplier}"), supplier=table(spark, sf, "supplier"))
    return saved_search.matched(jobs_v(spark, sf), searches)


@register("match_scope_listed", _LISTED_SCOPE + "SELECT candidate_id, id FROM pairs")
def match_scope_listed(spark, sf):
    """Scopes from comma-separated ids, as a user would send them."""
    listed = listed_v(spark, sf)
    as_text = listed.select("candidate_id", F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(",, ")).alias("job_ids"))
    return matching.scope_by_ids(candidates_v(spark, sf), jobs_v(spark, sf), matching.listed_ids(as_text)).select("candidate_id", "id")


@register("match_skills", _LISTED_SCOPE + _SCORED + """SELECT candidate_id, id, array_to_string(matching_skills, '|') AS matching_skills,
    array_to_string(missing_skills, '|') AS missing_skills FROM scored""")
def match_skills(spark, sf):
    overlap = matching.skill_overlap(_listed(spark, sf))
    return overlap.select(
        "candidate_id", "id", F.array_join("matching_skills", "|").alias("matching_skills"),
        F.array_join("missing_skills", "|").alias("missing_skills"),
    )


@register("match_top10", _filter_scope() + _SCORED + _RESULT)
def match_top10(spark, sf):
    return _result(matching.score_pairs(_filtered(spark, sf)))


@register("match_top10_listed", _LISTED_SCOPE + _SCORED + _RESULT)
def match_top10_listed(spark, sf):
    return _result(matching.score_pairs(_listed(spark, sf)))


@register("match_bands", _filter_scope() + _SCORED + """SELECT candidate_id, id, match_score, CASE WHEN match_score >= 90 THEN 'near-perfect'
    WHEN match_score >= 70 THEN 'strong' WHEN match_score >= 50 THEN 'moderate' ELSE 'weak' END AS band FROM scored""")
def match_bands(spark, sf):
    scored = matching.score_pairs(_filtered(spark, sf))
    return scored.select("candidate_id", "id", "match_score", matching.match_band(F.col("match_score")).alias("band"))


def _items(spark, sf):
    return parse_matches(match_replies_v(spark, sf).select("candidate_id", "reply"))


def _flat_items(rows):
    return flat(rows).withColumns({c: F.array_join(c, "|") for c in ("matching_skills", "missing_skills")})


@register("match_parse", using("match_items") + "SELECT candidate_id, job_id, match_score, matching_skills, missing_skills, summary FROM match_items")
def match_parse(spark, sf):
    return _flat_items(_items(spark, sf))


@register("match_errors", "SELECT o_custkey AS candidate_id, o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 11 = 0")
def match_parse_errors(spark, sf):
    return match_errors(match_replies_v(spark, sf)).select("candidate_id", "o_orderkey")


_POSTING_SQL = ", ".join(
    f"CASE WHEN j.id IS NOT NULL THEN coalesce(array_to_string(j.{f}, '|'), '') END AS {f}"
    if f in ("tech_stack", "skills", "pain_points") else f"j.{f}"
    for f in JOB_FIELDS if f != "id"
)


@register("match_enrich", using("match_items", "jobs_v") + f"""SELECT m.job_id AS id, candidate_id, match_score, matching_skills, missing_skills, summary,
    {_POSTING_SQL} FROM match_items m LEFT JOIN jobs_v j ON m.job_id = j.id""")
def match_enrich(spark, sf):
    return _flat_items(matching.with_jobs(_items(spark, sf), jobs_v(spark, sf)))


@register("match_report", using("match_items", "jobs_v", "listed_v") + f"""SELECT m.job_id AS id, m.candidate_id, m.place, m.match_score, m.matching_skills,
        m.missing_skills, m.summary, {_POSTING_SQL}, coalesce(n, 0) AS jobs_analyzed
    FROM (SELECT candidate_id, job_id, coalesce(match_score, 0::DOUBLE) AS match_score, coalesce(matching_skills, '') AS matching_skills,
            coalesce(missing_skills, '') AS missing_skills, coalesce(summary, '') AS summary,
            CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(match_score, 0::DOUBLE) DESC, job_id) AS INT) AS place FROM match_items) m
    LEFT JOIN jobs_v j ON m.job_id = j.id LEFT JOIN (SELECT candidate_id, count(*) AS n FROM listed_v GROUP BY candidate_id) l
        ON l.candidate_id = m.candidate_id WHERE place <= 10""")
def match_report(spark, sf):
    return _flat_items(matching.match_report(_items(spark, sf), jobs_v(spark, sf), listed_v(spark, sf)))


@register("match_prompts", _LISTED_SCOPE + f""", blocks AS (SELECT candidate_id, count(*) AS job_count, string_agg({_BLOCK}, '' ORDER BY id) AS listing
        FROM pairs GROUP BY candidate_id)
    SELECT b.candidate_id, job_count, concat('Compare this resume with the postings and score each from 0 to 100: skills 40 %, level 30 %, ',
        'domain 20 %, potential 10 %. Answer with a JSON list of the ten best, highest first, ',
        'with job_id, match_score, matching_skills, missing_skills, summary.', chr(10), chr(10), 'Resume:', chr(10), substring(text, 1, 8000),
        chr(10), chr(10), 'Postings (', job_count, '):', chr(10), substring(listing, 1, 12000)) AS prompt
    FROM blocks b JOIN candidates_v c ON b.candidate_id = c.candidate_id""")
def match_prompts(spark, sf):
    return matching.match_prompts(_listed(spark, sf), candidates_v(spark, sf).select("candidate_id", "text"))
