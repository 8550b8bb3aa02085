import glob
import os
import random

from rolescope.plans.profiles import apply_changes, company_profiles, create_counts, profiles_of_counts
from rolescope.schemas import KEY

def shown(profiles):
    return sorted(map(str, profiles.drop("analyzed_at").collect()))


def some(draw, i, company):
    return {"id": i, "job_id": str(i), "company": company, "department": draw.choice([None, "", "Sales", "Engineering"]), "seniority": draw.choice([None, "VP", "Mid"]),
            "tech_stack": draw.choice([None, [], ["go", "sql"], ["go", None], ["go", "go"]]), "skills": draw.choice([None, ["x", ""]]), "pain_points": None}


def test_batches_equal_a_full_rebuild(spark, jobs_from, tmp_path):
    draw = random.Random(1)
    held = {i: some(draw, i, draw.choice(["a", "b", "hot"])) for i in range(60)}
    counts = create_counts(jobs_from(*held.values()), str(tmp_path / "counts"), buckets=6)
    for batch in range(3):
        picked = draw.sample(sorted(held), 12)
        before = jobs_from(*[held[i] for i in picked])
        for i in picked[:3]:
            del held[i]
        changed = {i: some(draw, i, draw.choice(["b", "hot", "new"])) for i in [*picked[3:], 100 + batch]}
        held |= changed
        counts = apply_changes(counts, before, jobs_from(*changed.values()))
        assert shown(profiles_of_counts(counts)) == shown(company_profiles(jobs_from(*held.values())))
    everything = jobs_from(*held.values())
    assert profiles_of_counts(apply_changes(counts, everything, everything.limit(0))).count() == 0


def test_a_batch_writes_the_buckets_of_its_values_only(spark, jobs_from, tmp_path):
    rows = [{"id": i, "job_id": str(i), "company": f"c{i}", "department": "HR"} for i in range(300)]
    counts = create_counts(jobs_from(*rows), str(tmp_path / "counts"), buckets=100)
    after = apply_changes(counts, jobs_from(rows[0]), jobs_from(rows[0] | {"department": "Sales"}))
    written = {int(os.path.basename(p)[7:]) for p in glob.glob(str(tmp_path / "counts/data/v=[1-9]*/bucket=*"))}
    assert len(written) <= 2 and after.rows == counts.rows == 600
    unchanged = apply_changes(after, jobs_from(rows[5]), jobs_from(rows[5] | {"title": "other"}))
    assert unchanged.read().count() == 600 and set(KEY) <= set(jobs_from(rows[0]).columns)
