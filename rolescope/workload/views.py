"""Job-posting views derived from the given tables, for Spark.

``views_sql`` states the same views for the oracle. Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw spellings that exercise the normalizer.
TECHNOLOGIES = [
    "Node.js", "k8s", "Postgres", "python3", "Golang", "React", "AWS", "pyspark", "Terraform", "C++", "Docker",
    "Snowflake", "Apache Kafka", "tf", "Redis", "dbt", "TypeScript", "GCP", "Rust", "ts",
]
SKILLS = ["Problem Solving", "team player", "REST API", "Communication", "System Design", "Scrum", "data analytics"]
ATS = ["greenhouse", "lever", "ashby", "smartrecruiters"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(index) + 1).cast("int"))


def _bit(values: list[str], value: Column, shift: int) -> Column:
    """One bit, that of the value's place in ``values``."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), value) - 1
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place + shift).cast("int"))


def _marked(values: list[str], shift: int) -> Column:
    """The values whose bits are set, in their order."""
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda _, i: F.call_function("getbit", F.col("marks"), i + shift) == 1)


def jobs_v(spark: SparkSession, sf: str) -> DataFrame:
    """One posting per order."""
    # What is picked by a part's number travels as one bit each, and the rest as it stands in the table: an order's lists are made once, after the shuffle.
    # Orders have few lines, so nothing is gained by reducing them before it.
    tech, skills = sorted(TECHNOLOGIES), sorted(SKILLS)
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_name", F.lower("p_type").alias("p_type"),
        (_bit(tech, _pick(TECHNOLOGIES, "p_partkey % 20"), 0) + _bit(skills, _pick(SKILLS, "p_partkey % 7"), len(tech))).alias("marks"),
    )
    lines = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "p_name", "p_type", "marks")
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.min("p_name").alias("title"), F.bit_or("marks").alias("marks"), F.array_sort(F.collect_set("p_type")).alias("types"))
        .select(
            "l_orderkey", "title", _marked(tech, 0).alias("tech_stack"), _marked(skills, len(tech)).alias("skills"),
            F.transform("types", lambda kind: F.concat(F.lit("scale "), kind)).alias("pain_points"),
        )
    )
    orders = table(spark, sf, "orders").selectExpr(
        "*", "o_custkey % (1 + o_orderkey % 200) AS cno", "o_orderkey % 12 AS d"
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
        "CAST(o_orderkey + 1 AS BIGINT) AS id",
        "CAST(o_orderkey AS STRING) AS job_id",
        "concat('company_', CAST(cno AS STRING)) AS company",
        "CASE (cno + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' "
        "WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END AS ats",
        "coalesce(title, 'untitled') AS title",
        "concat('https://jobs.example.com/company_', CAST(cno AS STRING), '/', CAST(o_orderkey AS STRING)) AS url",
        "CASE WHEN o_orderkey % 9 <> 0 THEN concat('City_', CAST(o_custkey % 37 AS STRING)) END AS location",
        "CASE WHEN d <= 3 THEN 'Engineering' WHEN d <= 5 THEN 'Sales' WHEN d = 6 THEN 'Marketing' WHEN d = 7 THEN 'Product' "
        "WHEN d = 8 THEN 'Design' WHEN d = 9 THEN 'Finance' END AS department",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Staff' WHEN '2-HIGH' THEN 'Senior' WHEN '3-MEDIUM' THEN 'Mid' "
        "WHEN '5-LOW' THEN 'Junior' END AS seniority",
        "CASE WHEN d < 10 THEN tech_stack END AS tech_stack",
        "CASE WHEN d < 10 THEN skills END AS skills",
        "CASE WHEN d < 10 THEN pain_points END AS pain_points",
        "CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'Hybrid' END AS remote_policy",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 2) AS INT) END AS salary_min",
        "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS INT) END AS salary_max",
        "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 16 AS INT) END AS experience_years",
        "concat(coalesce(title, 'untitled'), ' role at company_', CAST(cno AS STRING)) AS job_summary",
        "concat(coalesce(title, 'untitled'), ' wanted, priority ', o_orderpriority) AS raw_description",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) AS scraped_at",
        "CASE WHEN d < 10 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) END AS parsed_at",
    )


def scraped_v(spark: SparkSession, sf: str) -> DataFrame:
    """One scraped posting per document."""
    return table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS job_id",
        "source AS company",
        "CASE lang WHEN 'en' THEN 'greenhouse' WHEN 'fr' THEN 'lever' WHEN 'de' THEN 'ashby' ELSE 'smartrecruiters' END AS ats",
        "concat('Opening ', CAST(doc_id AS STRING), ' at ', source) AS title",
        "concat('https://jobs.example.com/', source, '/', CAST(doc_id AS STRING)) AS url",
        "CASE WHEN doc_id % 9 <> 0 THEN concat('City_', CAST(doc_id % 37 AS STRING)) END AS location",
        "CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS description",
    )


def changes_v(spark: SparkSession, sf: str) -> DataFrame:
    """One scraped posting per order line: several versions of known postings, and new postings."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.selectExpr("*", "o_custkey % (1 + o_orderkey % 200) AS cno").selectExpr(
        "concat(CAST(o_orderkey AS STRING), CASE WHEN l_linenumber > 4 THEN concat('-', CAST(l_linenumber AS STRING)) ELSE '' END) AS job_id",
        "concat(CASE WHEN l_linenumber > 6 THEN 'branch_' ELSE 'company_' END, CAST(cno AS STRING)) AS company",
        "CASE (cno + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' "
        "WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END AS ats",
        "concat('line ', CAST(l_linenumber AS STRING), ' of part ', CAST(l_partkey AS STRING)) AS title",
        "CASE WHEN l_returnflag <> 'N' THEN concat('https://jobs.example.com/supplier_', CAST(l_suppkey AS STRING)) END AS url",
        "concat('City_', CAST(l_suppkey % 37 AS STRING)) AS location",
        "concat('quantity ', CAST(CAST(l_quantity AS INT) AS STRING), ' flag ', l_returnflag) AS raw_description",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS scraped_at",
        "concat(lpad(CAST(l_partkey AS STRING), 9, '0'), '-', lpad(CAST(l_suppkey AS STRING), 9, '0')) AS file",
        "l_linenumber AS pos",
        "CASE WHEN l_discount > 0.02 THEN 'Engineering' WHEN l_discount > 0 THEN 'Sales' END AS department",
        "CASE l_linestatus WHEN 'F' THEN 'Senior' END AS seniority",
        "CASE WHEN l_tax > 0.02 THEN array('python', 'go') WHEN l_tax > 0 THEN array() END AS tech_stack",
        "array('sql') AS skills",
        "CAST(array() AS ARRAY<STRING>) AS pain_points",
        "CASE l_returnflag WHEN 'R' THEN 'Remote' END AS remote_policy",
        "CAST(l_quantity AS INT) * 1000 AS salary_min",
        "CAST(NULL AS INT) AS salary_max",
        "CAST(l_linenumber AS INT) AS experience_years",
        "concat('ships ', CAST(l_suppkey AS STRING)) AS job_summary",
    )


_PAYLOADS = {
    "greenhouse": """concat('{"jobs":[{"id":', a, ',"title":"', p_name, '","location":{"name":"', p_brand,
        '"},"content":"&lt;p&gt;', p_type, '&lt;/p&gt;&lt;p&gt;Size ', p_size, '&lt;/p&gt;"},{"id":', b,
        ',"title":"', p_name, ' lead","location":{},"content":"R&amp;D ', p_type, '"}]}')""",
    "lever": """CASE WHEN p_size = 50 THEN '{"jobs":[]}' ELSE concat('[{"id":"', a, '","text":"', p_name,
        '","categories":{"location":"', p_brand, '"},"hostedUrl":"https://lever.example.com/', a,
        '","descriptionPlain":"', p_type, '"},{"id":"', b, '","text":"', p_name, ' lead"}]') END""",
    "ashby": """concat('{"jobs":[{"id":"', a, '","title":"', p_name, '","location":"', p_brand,
        '","jobUrl":"https://ashby.example.com/', a, '","descriptionPlain":"', p_type, '"},{"id":"', b,
        '","title":"', p_name, ' lead","location":null}]}')""",
    "smartrecruiters": """concat('{"content":[{"id":"', a, '","name":"', p_name, '","location":{"city":"', p_brand,
        '"}},{"id":"', b, '","name":"', p_name, ' lead","location":null}]}')""",
    "homegrown": """concat('{"jobs":[{"id":', a, '}]}')""",
}
_NO_JOBS = '{"jobs":[]}'
_EMPTY = {"lever": "[]", "smartrecruiters": '{"content":[]}'}


def _spread_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The parts, dealt out to all tasks: a small file of them makes many payloads, and would be one task."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf, "part").repartition(tasks, "p_partkey")


def payload_v(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per part and system, two postings each; some are cut short, some hold no postings."""
    parts = _spread_parts(spark, sf).selectExpr(
        "*", "CAST(2 * p_partkey AS STRING) AS a", "CAST(2 * p_partkey + 1 AS STRING) AS b",
        "concat('board', CAST(p_partkey AS STRING)) AS slug",
    )
    bodies = ", ".join(
        f"named_struct('ats', '{ats}', 'body', {body}, 'none', '{_EMPTY.get(ats, _NO_JOBS)}')"
        for ats, body in _PAYLOADS.items()
    )
    return parts.selectExpr("slug", "p_partkey", f"inline(array({bodies}))").selectExpr(
        "ats", "slug",
        "CASE WHEN p_partkey % 13 = 0 THEN substring(body, 1, length(body) - 2) WHEN p_partkey % 17 = 0 THEN none ELSE body END AS raw",
    )


def details_v(spark: SparkSession, sf: str) -> DataFrame:
    """The detail document of each part's first posting."""
    return _spread_parts(spark, sf).selectExpr(
        "concat('board', CAST(p_partkey AS STRING)) AS slug",
        "CAST(2 * p_partkey AS STRING) AS id",
        """concat('{"jobAd":{"sections":{"companyDescription":{"title":"About","text":"<b>', p_brand, '</b> &amp; co"},',
            '"jobDescription":{"title":"The job","text":"<p>', p_type, '</p><p>size ', p_size, '</p>"},',
            '"qualifications":{"title":"","text":"', p_name, '"},"additionalInformation":{"title":"More","text":""}}}}') AS raw""",
    )


def responses_v(spark: SparkSession, sf: str) -> DataFrame:
    """One model reply per document, in seven shapes."""
    body = (
        """concat('{"department": "', element_at(array('Engineering', 'Sales', 'Product', 'Gardening'), CAST(doc_id % 4 + 1 AS INT)),"""
        """ '", "tech_stack": ["K8s", " node.js "], "salary_min": ', CAST(100000 + doc_id AS STRING), ', "extra": {"k": ', CAST(doc_id AS STRING), '}}')"""
    )
    return table(spark, sf, "documents").selectExpr("doc_id", f"{body} AS body").selectExpr(
        "CAST(doc_id AS STRING) AS job_id",
        "CASE doc_id % 7 WHEN 0 THEN body WHEN 1 THEN concat('```json', char(10), body, char(10), '```') "
        "WHEN 2 THEN concat('Here is the answer: ', body, ' Anything else?') WHEN 3 THEN concat('```', char(10), body, char(10), '```') "
        "WHEN 4 THEN substring(body, 1, 30) WHEN 5 THEN 'I could not read this posting.' END AS reply",
    )


_LEVELS = (
    "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Junior' WHEN 'FURNITURE' THEN 'Mid' WHEN 'BUILDING' THEN 'Senior' "
    "WHEN 'AUTOMOBILE' THEN 'Staff' END"
)
_CANDIDATE_DEPARTMENTS = (
    "CASE c_nationkey % 6 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' WHEN 2 THEN 'Marketing' WHEN 3 THEN 'Product' "
    "WHEN 4 THEN 'Design' ELSE 'Finance' END"
)


def candidates_v(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per customer, with terms from the customer's orders."""
    terms = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.array_union(
            F.collect_set(_pick(TECHNOLOGIES, "o_orderkey % 20")), F.collect_set(_pick(SKILLS, "o_orderkey % 7")))).alias("terms")
    )
    customers = table(spark, sf, "customer")
    return customers.join(terms, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "c_custkey AS candidate_id",
        "coalesce(terms, CAST(array() AS ARRAY<STRING>)) AS terms",
        f"{_LEVELS} AS level",
        f"{_CANDIDATE_DEPARTMENTS} AS department",
        f"CASE WHEN c_nationkey % 3 <> 0 THEN {_CANDIDATE_DEPARTMENTS} END AS want_department",
        f"CASE WHEN c_nationkey % 2 = 0 THEN coalesce({_LEVELS}, '') ELSE '' END AS want_seniority",
        "concat(c_name, ', ', lower(c_mktsegment), '. Knows: ', coalesce(array_join(terms, ', '), 'nothing yet')) AS text",
    )


def listed_v(spark: SparkSession, sf: str) -> DataFrame:
    """The postings a candidate lists: those of its own orders."""
    return table(spark, sf, "orders").selectExpr("o_custkey AS candidate_id", "CAST(o_orderkey + 1 AS BIGINT) AS id")


def registry_v(spark: SparkSession, sf: str) -> DataFrame:
    """One board per supplier; some lack a name, a system or a slug."""
    return table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS position",
        "CASE WHEN s_acctbal >= 1000 THEN s_name END AS name",
        "CASE WHEN s_nationkey = 3 THEN NULL ELSE element_at(array('greenhouse', 'lever', 'ashby', 'smartrecruiters'), CAST(s_suppkey % 4 + 1 AS INT)) END AS ats",
        "CASE WHEN s_nationkey = 7 THEN '' ELSE concat('company_', CAST(2 * s_suppkey AS STRING)) END AS slug",
    )


def match_replies_v(spark: SparkSession, sf: str) -> DataFrame:
    """One match reply per order: plain, fenced, broken, or naming an unknown posting."""
    one = (
        """concat('{"job_id": ', CAST(CASE WHEN o_orderkey % 19 = 0 THEN -1 - o_orderkey ELSE o_orderkey + 1 END AS STRING), """
        """CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat(', "match_score": ', CAST(o_orderkey % 101 AS STRING)) END, """
        """CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ', "matching_skills": ["sql", "go"], "missing_skills": ["rust"]' END, """
        """CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', "summary": "fits ', o_orderstatus, '"') END, '}')"""
    )
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS candidate_id", f"{one} AS one").selectExpr(
        "candidate_id", "o_orderkey",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('```json', char(10), '[', one, ']', char(10), '```') "
        "WHEN o_orderkey % 11 = 0 THEN concat('Sorry: [', one) ELSE concat('[', one, ']') END AS reply",
    )
