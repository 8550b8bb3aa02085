"""Structured extraction with a stand-in model that answers from the prompt's length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import reply_fields, salvage_json
from ..functions.terms import TECH, dictionary_table
from ..operators import dictionaries, extract, quality, reply_store, rules
from ..schemas import SENIORITIES
from ..session import new_work_dir
from .registry import register
from .terms_sql import TECH_MAP
from .text_queries import PROMPT_SQL
from .views import jobs_v, responses_v, scraped_v
from .views_sql import literals, using


def length_model():
    """A model whose reply depends on the prompt's length only, in the shapes real models reply in."""

    def answer(prompts):
        replies = []
        for prompt in prompts:
            n = len(prompt)
            body = (
                '{"department": "%s", "tech_stack": ["K8s", " node.js ", "kube"], "skills": ["Scrum"], '
                '"salary_min": %d, "extra": {"k": 1}}' % ("Sales" if n % 2 else "Engineering", n)
            )
            shapes = [body, f"```json\n{body}\n```", f"Here: {body} Done.", body[:20], "{}"]
            replies.append(shapes[n % 5])
        return replies

    return answer


@register("salvage_json", f"""SELECT CAST(doc_id AS VARCHAR) AS job_id, CAST(found AS BOOLEAN) AS found,
        CASE WHEN found THEN department END AS department, CASE WHEN found THEN CAST(100000 + doc_id AS INT) END AS salary_min,
        CASE WHEN found THEN 'K8s| node.js ' END AS tech_stack
    FROM (SELECT doc_id, doc_id % 7 < 4 AS found, (['Engineering', 'Sales', 'Product', 'Gardening'])[CAST(doc_id % 4 + 1 AS INT)] AS department FROM documents)""")
def salvage(spark, sf):
    replies = responses_v(spark, sf).withColumn("json", salvage_json(F.col("reply")))
    replies = replies.withColumn("value", F.try_parse_json("json"))
    fields = reply_fields(F.col("value"))
    return replies.select(
        "job_id", F.col("json").isNotNull().alias("found"), fields["department"].alias("department"),
        fields["salary_min"].alias("salary_min"), F.array_join(fields["tech_stack"], "|").alias("tech_stack"),
    )


EXTRACTED_SQL = using("scraped_v") + f"""SELECT job_id, company, ats, url, CASE WHEN done THEN CASE WHEN n % 2 = 1 THEN 'Sales' ELSE 'Engineering' END END AS department,
        CASE WHEN done THEN CAST(n AS INT) END AS salary_min, CASE WHEN done THEN 'kubernetes|nodejs' END AS tech_stack,
        CASE WHEN done THEN 'scrum' END AS skills,
        CASE WHEN length(substring(description, 1, 8000)) < 100 THEN 'No description' WHEN NOT done THEN 'Failed to parse LLM response' END AS error
    FROM (SELECT *, n % 5 < 3 AND length(substring(description, 1, 8000)) >= 100 AS done
        FROM (SELECT *, length({PROMPT_SQL}) AS n FROM scraped_v))"""


def _extracted(spark, sf, model):
    return _flat(extract.extract_jobs(scraped_v(spark, sf), model))


def _flat(extracted):
    return extracted.select(
        "job_id", "company", "ats", "url", "department", "salary_min",
        F.array_join("tech_stack", "|").alias("tech_stack"), F.array_join("skills", "|").alias("skills"), "error",
    )


@register("extract_jobs", EXTRACTED_SQL)
def extract_jobs(spark, sf):
    return _extracted(spark, sf, length_model())


def limited_model():
    """The same model behind a rate limit: it turns away the first call of a task's batch and every fourth after it."""
    answer, calls = length_model(), []

    def limited(prompts):
        calls.append(len(prompts))
        if len(calls) % 4 == 1:
            raise RuntimeError("rate limit reached, retry after 0")
        return answer(prompts)

    return limited


@register("extract_retry", EXTRACTED_SQL)
def extract_retry(spark, sf):
    """Rate-limited calls are repeated until they answer."""
    return _extracted(spark, sf, extract.retrying(limited_model(), sleep=lambda seconds: None))

@register("extract_stored", EXTRACTED_SQL)
def extract_stored(spark, sf):
    """Two runs over one store of replies; the model of the second answers nothing, as nothing is left to ask."""
    store = reply_store.ReplyStore(spark, new_work_dir(spark, "replies"), "length", parts=4, parallelism=8)
    reply_store.extract_stored(scraped_v(spark, sf), length_model(), store)
    return _flat(reply_store.extract_stored(scraped_v(spark, sf), lambda prompts: [None] * len(prompts), store))


@register("extract_quality", f"""SELECT CASE lang WHEN 'en' THEN 'greenhouse' WHEN 'fr' THEN 'lever' WHEN 'de' THEN 'ashby' ELSE 'smartrecruiters' END AS ats,
        count(*) AS rows, count(*) FILTER (WHERE doc_id % 7 < 4 AND doc_id % 4 = 3) AS department_unknown,
        CAST(0 AS BIGINT) AS seniority_unknown, CAST(0 AS BIGINT) AS remote_policy_unknown
    FROM documents GROUP BY 1""")
def extract_quality(spark, sf):
    replies = responses_v(spark, sf).join(scraped_v(spark, sf).select("job_id", "ats"), "job_id")
    replies = replies.withColumn("value", F.try_parse_json(salvage_json(F.col("reply"))))
    fields = reply_fields(F.col("value"))
    return quality.extract_quality(replies.select("ats", *[fields[c].alias(c) for c in ("department", "seniority", "remote_policy")]))


_TITLE = "concat_ws(' ', seniority, title)"
_ADVERT = """concat_ws(' ', concat('Our stack: ', {join}(tech_stack, ', '), '.'),
    concat('Pay from $', CAST(salary_min AS {text}), '.'), concat('Up to ', CAST(salary_max AS {text}), '!'), concat(CAST(experience_years AS {text}), '+ years.'),
    CASE remote_policy WHEN 'Remote' THEN 'Fully REMOTE.' WHEN 'Hybrid' THEN '(hybrid)' END, 'Machine learning, Power BI and .NET are a plus')"""
_GRAMS = " ".join(["list_concat(words,", ", ".join(
    f"list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))" for n in (2, 3)), ")"])


_FOUND = using("jobs_v").rstrip() + f""", adverts AS (SELECT id, {_TITLE} AS advert_title, {_ADVERT.format(join='array_to_string', text='VARCHAR')} AS description FROM jobs_v),
    parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(description), '{rules.WORD_BREAK}'), lambda w: rtrim(w, './-')), lambda w: w <> '') AS words,
        list_transform(regexp_extract_all(description, '{rules.PAY}'), lambda d: CAST(regexp_replace(d, '[$,]', '', 'g') AS INT)) AS pay FROM adverts),
    grams AS (SELECT *, {_GRAMS} AS spellings FROM parts)
    """


@register("extract_rules", _FOUND + f"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter({literals(TECH)}, lambda k: list_contains(spellings, k)), lambda k: {TECH_MAP}[k]))), '|') AS tech_stack,
        list_min(pay) AS salary_min, list_max(pay) AS salary_max, TRY_CAST(nullif(regexp_extract(lower(description), '{rules.YEARS}', 1), '') AS INT) AS experience_years,
        CASE WHEN description ILIKE '%remote%' THEN 'Remote' WHEN description ILIKE '%hybrid%' THEN 'Hybrid' ELSE 'Unknown' END AS remote_policy,
        ({literals(SENIORITIES)})[list_position({literals(s.lower() for s in SENIORITIES)}, lower(regexp_extract(advert_title, '{rules.LEVEL}', 1)))] AS seniority
    FROM grams""")
def extract_rules(spark, sf):
    text = _ADVERT.format(join="array_join", text="STRING")
    found = rules.extract_by_rules(jobs_v(spark, sf).selectExpr("id", f"{_TITLE} AS title", f"{text} AS description"))
    return found.select(
        "id", F.array_join("tech_stack", "|").alias("tech_stack"), "salary_min", "salary_max", "experience_years",
        "remote_policy", "seniority",
    )


@register("find_terms_table", _FOUND + f"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(
    list_filter({literals(TECH)}, lambda k: list_contains(spellings, k)), lambda k: {TECH_MAP}[k]))), '|') AS tech_stack FROM grams""")
def find_terms_table(spark, sf):
    """Technologies found in descriptions with the dictionary as a table."""
    adverts = jobs_v(spark, sf).selectExpr("id", f"{_ADVERT.format(join='array_join', text='STRING')} AS description")
    found = dictionaries.find_terms(adverts, ["id"], "description", dictionary_table(spark).where("kind = 'tech_stack'"))
    return found.select("id", F.array_join("terms", "|").alias("tech_stack"))
