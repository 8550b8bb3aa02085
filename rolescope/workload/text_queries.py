"""Term dictionaries, HTML cleaning, prompts and batch numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms, text
from ..operators import dictionaries, extract, ranking
from .registry import register
from .terms_sql import SKILL_MAP, TECH_MAP, canonical, canonical_list
from .views import jobs_v, responses_v, scraped_v, table
from .views_sql import literal, using

JOBS, SCRAPED = using("jobs_v"), using("scraped_v")
_WS = literal(text.WHITESPACE)


@register("normalize_term", JOBS + f"""SELECT id, term, {canonical('term', TECH_MAP)} AS canonical
    FROM (SELECT id, unnest(list_concat(tech_stack, skills)) AS term FROM jobs_v)""")
def normalize_term(spark, sf):
    exploded = jobs_v(spark, sf).select("id", F.explode(F.concat("tech_stack", "skills")).alias("term"))
    return exploded.withColumn("canonical", terms.normalize_term(F.col("term"), terms.TECH))


@register("normalize_tech", JOBS + f"SELECT id, array_to_string({canonical_list('tech_stack', TECH_MAP)}, '|') AS tech_stack FROM jobs_v")
def normalize_tech(spark, sf):
    return jobs_v(spark, sf).select("id", F.array_join(terms.normalize_tech_stack(F.col("tech_stack")), "|").alias("tech_stack"))


@register("normalize_tech_table", JOBS + f"SELECT id, array_to_string({canonical_list('tech_stack', TECH_MAP)}, '|') AS tech_stack FROM jobs_v")
def normalize_tech_table(spark, sf):
    """The same with the dictionary as a table."""
    dictionary = terms.dictionary_table(spark).where("kind = 'tech_stack'")
    normalized = dictionaries.normalize_lists(jobs_v(spark, sf).select("id", "tech_stack"), "tech_stack", dictionary)
    return normalized.select("id", F.array_join("tech_stack", "|").alias("tech_stack"))


@register("normalize_skills", JOBS + f"SELECT id, array_to_string({canonical_list('skills', SKILL_MAP)}, '|') AS skills FROM jobs_v")
def normalize_skills(spark, sf):
    return jobs_v(spark, sf).select("id", F.array_join(terms.normalize_skills(F.col("skills")), "|").alias("skills"))


@register("canonical_terms", JOBS + f"""SELECT DISTINCT 'tech_stack' AS kind, {canonical('t', TECH_MAP)} AS term FROM (SELECT unnest(tech_stack) AS t FROM jobs_v)
    UNION ALL SELECT DISTINCT 'skills', {canonical('t', SKILL_MAP)} FROM (SELECT unnest(skills) AS t FROM jobs_v)""")
def canonical_terms(spark, sf):
    """The canonical names in use: spellings met in postings, joined to the dictionary by spelling."""
    def met(column, kind):
        spelled = F.explode(column).alias("spelled")
        return jobs_v(spark, sf).select(F.lit(kind).alias("kind"), spelled).distinct()

    spellings = met("tech_stack", "tech_stack").unionByName(met("skills", "skills"))
    cleaned = spellings.withColumn("variant", text.strip(F.lower("spelled")))
    named = cleaned.join(terms.dictionary_table(spark), ["kind", "variant"], "left")
    return terms.canonical_terms(named.withColumn("canonical", F.coalesce("canonical", "variant")))


def _decoded(column: str) -> str:
    """The entities the pages hold, decoded once; some lost their semicolon where a title was cut."""
    for entity, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("middot", "chr(183)"), ("copy", "chr(169)"), ("amp", "'&'")):
        column = f"regexp_replace({column}, '&{entity};?', {char}, 'g')"
    return column


# RE2 never backtracks and has no possessive quantifiers.
_MARKUP = literal(text.MARKUP.replace("++", "+").replace("*+", "*"))


def _visible(column: str) -> str:
    stripped = f"regexp_replace({column}, {_MARKUP}, chr(10), 'g')"
    lines = f"list_transform(string_split({_decoded(stripped)}, chr(10)), lambda line: trim(line, {_WS}))"
    return f"coalesce(array_to_string(list_filter({lines}, lambda line: line <> ''), chr(10)), '')"


@register("clean_html", f"SELECT page_id, {_visible('html')} AS text FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


_SHOWN = """CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    ELSE concat(url, ' R&amp;D') END"""


@register("clean_description", f"""SELECT page_id, CASE WHEN contains(raw, '<') OR contains(raw, '&lt;') THEN {_visible(_decoded('raw'))} ELSE raw END AS text
    FROM (SELECT page_id, {_SHOWN} AS raw FROM pages)""")
def clean_description(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", f"{_SHOWN} AS raw")
    return pages.select("page_id", text.clean_description(F.col("raw")).alias("text"))


@register("strip_tags", f"SELECT page_id, trim(regexp_replace(html, '<[^>]+>', ' ', 'g'), {_WS}) AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


PROMPT_SQL = f"""concat({literal(text.PROMPT_HEAD)}, title, chr(10), 'Employer: ', company, chr(10), 'Place: ', coalesce(location, ''),
    chr(10), 'Text:', chr(10), substring(description, 1, 8000), {literal(text.PROMPT_TAIL)})"""


@register("extract_prompts", SCRAPED + f"SELECT job_id, {PROMPT_SQL} AS prompt FROM scraped_v WHERE length(substring(description, 1, 8000)) >= 100")
def extract_prompts(spark, sf):
    gated = extract.gate_description(scraped_v(spark, sf)).where("error IS NULL")
    columns = [F.col(c) for c in ("title", "company", "location", "description")]
    return gated.select("job_id", text.extraction_prompt(*columns).alias("prompt"))


@register("gate_description", SCRAPED + """SELECT job_id, substring(description, 1, 8000) AS description,
    CASE WHEN length(substring(description, 1, 8000)) < 100 THEN 'No description' END AS error FROM scraped_v""")
def gate_description(spark, sf):
    return extract.gate_description(scraped_v(spark, sf)).select("job_id", "description", "error")


REPLY_BODY = """concat('{"department": "', (['Engineering', 'Sales', 'Product', 'Gardening'])[CAST(doc_id % 4 + 1 AS INT)],
    '", "tech_stack": ["K8s", " node.js "], "salary_min": ', 100000 + doc_id, ', "extra": {"k": ', doc_id, '}}')"""


@register("strip_fence", f"""SELECT job_id, shown AS text, CASE WHEN shown LIKE '%;' THEN shown ELSE concat(shown, ';') END AS statement FROM (
    SELECT CAST(doc_id AS VARCHAR) AS job_id, CASE doc_id % 7 WHEN 2 THEN concat('Here is the answer: ', {REPLY_BODY}, ' Anything else?')
        WHEN 4 THEN trim(substring({REPLY_BODY}, 1, 30)) WHEN 5 THEN 'I could not read this posting.' WHEN 6 THEN NULL ELSE {REPLY_BODY} END AS shown
    FROM documents) WHERE shown IS NOT NULL""")
def strip_fence(spark, sf):
    replies = responses_v(spark, sf).where("reply IS NOT NULL")
    bare = replies.select("job_id", text.strip_fence(F.col("reply")).alias("text"))
    return bare.withColumn("statement", text.terminate_sql(F.col("text")))


@register("batch_numbers", SCRAPED + """SELECT job_id, ats, company,
    CAST((row_number() OVER (PARTITION BY ats, company ORDER BY job_id) - 1) // 10 AS INT) AS batch_id FROM scraped_v""")
def batch_numbers(spark, sf):
    return ranking.batch_numbers(scraped_v(spark, sf).select("job_id", "ats", "company"))
