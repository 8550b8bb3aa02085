import math
import random

import pytest
from pyspark.sql import functions as F

from rolescope.operators import matching, saved_search
from rolescope.schemas import SENIORITIES

LEVELS = [None, *SENIORITIES]
DEPARTMENTS = [None, "Engineering", "Sales"]
# Each word and its names as a technology and as a skill.
NAMES = {
    "k8s": ("kubernetes", "k8s"),
    "Go": ("go", "go"),
    "python3": ("python", "python3"),
    "Scrum": ("scrum", "scrum"),
    "sql": ("sql", "sql"),
    "AWS": ("aws", "aws"),
}
WORDS = list(NAMES)


@pytest.fixture(scope="module")
def data(spark, jobs_from):
    rng = random.Random(3)
    postings = [{
        "id": i, "job_id": str(i), "department": rng.choice(DEPARTMENTS), "seniority": rng.choice(LEVELS[:5]),
        "tech_stack": rng.choice([None, [], rng.sample(WORDS, 3), rng.sample(WORDS, 1)]), "skills": rng.sample(WORDS, 2),
        "job_summary": rng.choice(["alpha", "beta", None]), "title": rng.choice(["one", "two"]),
    } for i in range(1, 201)]
    people = [(
        c, rng.sample(WORDS, rng.randint(0, 4)), rng.choice(LEVELS[:5]), rng.choice(DEPARTMENTS[1:]),
        rng.choice([None, "", "Sales", "Engineering", "Legal"]), rng.choice([None, "Senior", "Mid"]), f"resume {c}",
    ) for c in range(40)]
    schema = "candidate_id int, terms array<string>, level string, department string, want_department string, want_seniority string, text string"
    return postings, people, jobs_from(*postings), spark.createDataFrame(people, schema)


def score(person, posting):
    _, terms, own, department, *_ = person
    required = {NAMES[w][0] for w in posting["tech_stack"] or []} | {NAMES[w][1] for w in posting["skills"]}
    have = {name for w in terms for name in NAMES[w]}
    skills = len(required & have) / len(required) if required else 0.0
    level, potential = 0.5, 0.5
    if own and posting["seniority"]:
        step = SENIORITIES.index(posting["seniority"]) - SENIORITIES.index(own)
        level, potential = 1 - min(abs(step), 5) / 5, 1.0 if 0 <= step <= 1 else 0.0
    domain = 1.0 if department == posting["department"] else 0.0
    total = math.floor(100 * (0.4 * skills + 0.3 * level + 0.2 * domain + 0.1 * potential) + 1e-9)
    return total, sorted(required & have), sorted(required - have)


def expected_top(people, scope):
    rows = set()
    for person in people:
        ranked = sorted(((-score(person, p)[0], p["id"]) for p in scope(person)))[:10]
        rows |= {(person[0], place, pid, -s) for place, (s, pid) in enumerate(ranked, 1)}
    return rows


def filtered(postings, person, limit, keep=lambda p: True):
    hits = [p for p in postings if keep(p) and (not person[4] or p["department"] == person[4]) and (not person[5] or p["seniority"] == person[5])]
    return sorted(hits, key=lambda p: p["id"])[:limit]


@pytest.mark.parametrize("limit", [1, 20, 1000])
def test_top_in_filter_scope(data, limit):
    postings, people, jobs, candidates = data
    pairs = matching.scope_by_filters(candidates, jobs, limit)
    got = {(r.candidate_id, r.place, r.id, r.match_score) for r in matching.top_matches(matching.score_pairs(pairs)).collect()}
    assert got == expected_top(people, lambda person: filtered(postings, person, limit))


def test_scope_with_keyword(data):
    postings, people, jobs, candidates = data
    pairs = matching.scope_by_filters(candidates, jobs, 7, query="ALPHA")
    expected = {(c[0], p["id"]) for c in people for p in filtered(postings, c, 7, lambda p: p["job_summary"] == "alpha")}
    assert {(r.candidate_id, r.id) for r in pairs.collect()} == expected


@pytest.mark.parametrize("block", [1, 50])
def test_scope_with_own_keyword_and_company(spark, data, monkeypatch, block):
    postings, people, jobs, candidates = data
    monkeypatch.setattr(saved_search, "BLOCK", block)
    wanted = {c[0]: (["alpha", "", None, "nothing"][c[0] % 4], [None, "ACM", "other"][c[0] % 3]) for c in people}
    own = spark.createDataFrame([(c, *w) for c, w in wanted.items()], "candidate_id int, want_query string, want_company string")
    pairs = matching.scope_by_filters(candidates.join(own, "candidate_id"), jobs, 7, query="t")

    def passes(person, p):
        query, company = wanted[person[0]]
        words = [x.lower() for x in (p["title"], p["job_summary"] or "")]
        return any("t" in x for x in words) and (not query or any(query in x for x in words)) and company != "other"

    expected = {(c[0], p["id"]) for c in people for p in filtered(postings, c, 7, lambda p, c=c: passes(c, p))}
    assert {(r.candidate_id, r.id) for r in pairs.collect()} == expected and len(expected) > 50


def test_listed_scope_with_hot_posting_and_candidate(spark, data):
    postings, people, jobs, candidates = data
    listed = {(c, 1) for c in range(40)} | {(0, i) for i in range(1, 201)} | {(5, 999), (77, 3)}
    table = spark.createDataFrame(sorted(listed), "candidate_id int, id int")
    scored = matching.score_pairs(matching.scope_by_ids(candidates, jobs, table))
    by_id = {p["id"]: p for p in postings}
    got = {(r.candidate_id, r.id): (r.match_score, r.matching_skills, r.missing_skills) for r in scored.collect()}
    assert got == {(c, i): score(people[c], by_id[i]) for c, i in listed if c < 40 and i in by_id}
    top = {(r.candidate_id, r.place, r.id, r.match_score) for r in matching.top_matches(scored).collect()}
    assert top == expected_top(people, lambda person: [by_id[i] for c, i in sorted(listed) if c == person[0] and i in by_id])


def test_terms_are_normalized_before_the_joins(data):
    """The literal maps of both sides stand below the joins: they run once per candidate and posting, not once per pair."""
    _, _, jobs, candidates = data
    listed = candidates.select("candidate_id").join(jobs.select("id"), F.col("candidate_id") < F.col("id")).cache()
    plan = matching.scope_by_ids(candidates, jobs, listed)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    maps = [i for i, line in enumerate(plan) if "array_union" in line]
    assert len(joins) >= 2 and len(maps) == 2 and min(maps) > joins[0] and max(maps) > joins[1]


def test_terms_count_as_technologies_and_as_skills(spark, jobs_from):
    jobs = jobs_from({"id": 1, "tech_stack": ["ML", "k8s"], "skills": ["problem-solving", "Machine Learning", "Communication"]})
    people = spark.createDataFrame(
        [(1, ["Problem Solving", "Machine Learning", "Kubernetes"], None, None, None, None, "")],
        "candidate_id int, terms array<string>, level string, department string, want_department string, want_seniority string, text string")
    listed = spark.createDataFrame([(1, 1)], "candidate_id int, id long")
    row = matching.skill_overlap(matching.scope_by_ids(people, jobs, listed)).first()
    assert row.matching_skills == ["kubernetes", "machine-learning", "ml", "problem-solving"] and row.missing_skills == ["communication"]


def test_listed_ids(spark):
    rows = spark.createDataFrame([(1, "1, 2,,3,"), (2, " "), (3, "2,2"), (4, "x, 9, 99999999999999999999")], "candidate_id int, job_ids string")
    assert sorted(map(tuple, matching.listed_ids(rows).collect())) == [(1, 1), (1, 2), (1, 3), (3, 2), (4, 9)]
    assert sorted(map(tuple, matching.unlisted_ids(rows).collect())) == [(4, "99999999999999999999"), (4, "x")]


def test_bands(spark):
    rows = spark.createDataFrame([(s,) for s in (100, 90, 89, 70, 69, 50, 49, 0)], "s int").select(matching.match_band(F.col("s")))
    assert [r[0] for r in rows.collect()] == ["near-perfect"] * 2 + ["strong"] * 2 + ["moderate"] * 2 + ["weak"] * 2


def test_report_defaults_and_unknown_posting(spark, data):
    _, _, jobs, _ = data
    matches = spark.createDataFrame([(1, 3, 80, ["a"], None, "s"), (1, -5, None, None, None, None)],
                                    "candidate_id int, job_id int, match_score int, matching_skills array<string>, missing_skills array<string>, summary string")
    analyzed = spark.createDataFrame([(1, 3), (1, 4), (1, 5)], "candidate_id int, id int")
    rows = {r.id: r for r in matching.match_report(matches, jobs, analyzed).collect()}
    assert (rows[3].title is not None, rows[3].missing_skills, rows[3].jobs_analyzed, rows[3].place) == (True, [], 3, 1)
    assert (rows[-5].title, rows[-5].tech_stack, rows[-5].match_score, rows[-5].summary, rows[-5].place) == (None, None, 0, "", 2)


def test_prompts_cut_exactly(spark, data):
    from rolescope.functions.text import posting_block
    from rolescope.schemas import JOB_FIELDS

    _, _, jobs, candidates = data
    listed = jobs.select(F.lit(0).alias("candidate_id"), "id").union(jobs.where("id < 4").select(F.lit(1), "id"))
    pairs = matching.scope_by_ids(candidates, jobs, listed)
    prompts = {r.candidate_id: r for r in matching.match_prompts(pairs, candidates.select("candidate_id", "text")).collect()}
    blocks = [r[0] for r in jobs.orderBy("id").select(posting_block({f: F.col(f) for f in JOB_FIELDS})).collect()]
    assert prompts[0].job_count == 200 and prompts[0].prompt.endswith("Postings (200):\n" + "".join(blocks)[:12000])
    assert prompts[1].prompt.endswith("resume 1\n\nPostings (3):\n" + "".join(blocks[:3]))
