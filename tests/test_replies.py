import json

from pyspark.sql import functions as F

from rolescope.functions.replies import match_errors, parse_matches, reply_fields, salvage_json

OBJECT = '{"department": "Sales", "salary_min": "150000", "tech_stack": ["K8s", null], "x": {"y": 1}}'
VALUE = json.loads(OBJECT)
# Replies and the object to find in them, by hand.
FOUND = [
    (OBJECT, VALUE),
    (f"  {OBJECT}\n", VALUE),
    (f"```json\n{OBJECT}\n```", VALUE),
    (f"```\n{OBJECT}\n```", VALUE),
    (f"Sure: {OBJECT} Bye {{not json}}", VALUE),
    ('{"a": {"b": {"c": 1}}}', {"a": {"b": {"c": 1}}}),
    ('text {"a": {"b": 1}} text', {"a": {"b": 1}}),
    (OBJECT[:30], None),
    ("{}", {}),
    ("", None),
    (None, None),
    ("nothing here", None),
    ('{bad} then {"good": 1}', {"good": 1}),
    ('{"a": 1} trailing {"b": 2}', {"a": 1}),
    ('``` json {"a": 1} ```', {"a": 1}),
    ('{"a": 1, "a": 2}', {"a": 2}),
    ('[{"a": 1}]', {"a": 1}),
]


def test_salvage(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(FOUND)], "i int, r string")
    got = [r[1] for r in rows.select("i", salvage_json(F.col("r"))).orderBy("i").collect()]
    assert [None if g is None else json.loads(g) for g in got] == [value for _, value in FOUND]


def test_deep_nesting_does_not_overflow(spark):
    reply = "x {" + '"k": {"a": 1}, ' * 50_000 + "tail"
    assert spark.createDataFrame([(reply,)], "r string").select(salvage_json(F.col("r"))).first()[0] == '{"a": 1}'


def test_fields_by_type(spark):
    rows = spark.createDataFrame([(OBJECT,), ('{"salary_min": "high", "salary_max": 12.9, "skills": "one", "department": null}',)], "j string")
    fields = reply_fields(F.col("v"))
    first, second = rows.withColumn("v", F.try_parse_json("j")).select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert (first.department, first.salary_min, first.tech_stack, first.skills) == ("Sales", 150000, ["K8s", None], None)
    assert (second.salary_min, second.salary_max, second.skills, second.department) == (None, 12, None, None)


def test_match_replies(spark):
    item = {"job_id": 1, "match_score": 90, "matching_skills": ["a"], "missing_skills": [], "summary": "ok"}
    replies = [json.dumps([item]), f"```json\n{json.dumps([item, {'job_id': 2}])}\n```", "[broken", "{}", "[]", None, "[1] and [2]", '[{"job_id": "7", "match_score": 87.5, "summary": 3, "matching_skills": "x"}]']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = parse_matches(rows).orderBy("i", "job_id").collect()
    assert [(r.i, r.job_id, r.match_score, r.missing_skills, r.summary) for r in got] == [
        (0, 1, 90, [], "ok"), (1, 1, 90, [], "ok"), (1, 2, None, None, None), (7, 7, 87.5, None, "3")]
    assert sorted(r.i for r in match_errors(rows).collect()) == [2, 3, 5, 6]
