"""The views of ``views`` as DuckDB common table expressions."""

from __future__ import annotations

from .views import SKILLS, TECHNOLOGIES


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literals(values) -> str:
    return "[" + ", ".join(literal(v) for v in values) + "]"


_ATS_OF = (
    "CASE (cno + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' "
    "WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END"
)
_LEVEL = (
    "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Junior' WHEN 'FURNITURE' THEN 'Mid' WHEN 'BUILDING' THEN 'Senior' "
    "WHEN 'AUTOMOBILE' THEN 'Staff' END"
)
_DEPARTMENT = (
    "CASE c_nationkey % 6 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' WHEN 2 THEN 'Marketing' WHEN 3 THEN 'Product' "
    "WHEN 4 THEN 'Design' ELSE 'Finance' END"
)

# Name -> (views it reads, query).
VIEWS: dict[str, tuple[list[str], str]] = {
    "jobs_v": ([], f"""
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(o_orderkey AS VARCHAR) AS job_id,
            concat('company_', cno) AS company, {_ATS_OF} AS ats, coalesce(line_title, 'untitled') AS title,
            concat('https://jobs.example.com/company_', cno, '/', o_orderkey) AS url,
            CASE WHEN o_orderkey % 9 <> 0 THEN concat('City_', o_custkey % 37) END AS location,
            CASE WHEN d <= 3 THEN 'Engineering' WHEN d <= 5 THEN 'Sales' WHEN d = 6 THEN 'Marketing' WHEN d = 7 THEN 'Product'
                WHEN d = 8 THEN 'Design' WHEN d = 9 THEN 'Finance' END AS department,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Staff' WHEN '2-HIGH' THEN 'Senior' WHEN '3-MEDIUM' THEN 'Mid'
                WHEN '5-LOW' THEN 'Junior' END AS seniority,
            CASE WHEN d < 10 THEN lines.tech_stack END AS tech_stack,
            CASE WHEN d < 10 THEN lines.skills END AS skills,
            CASE WHEN d < 10 THEN lines.pain_points END AS pain_points,
            CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'Hybrid' END AS remote_policy,
            CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 2) AS INT) END AS salary_min,
            CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS INT) END AS salary_max,
            CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 16 AS INT) END AS experience_years,
            concat(coalesce(line_title, 'untitled'), ' role at company_', cno) AS job_summary,
            concat(coalesce(line_title, 'untitled'), ' wanted, priority ', o_orderpriority) AS raw_description,
            CAST(o_orderdate AS TIMESTAMP) AS scraped_at,
            CASE WHEN d < 10 THEN CAST(o_orderdate AS TIMESTAMP) END AS parsed_at
        FROM (SELECT *, o_custkey % (1 + o_orderkey % 200) AS cno, o_orderkey % 12 AS d FROM orders) o
        LEFT JOIN (
            SELECT l_orderkey, min(p_name) AS line_title,
                list_sort(array_agg(DISTINCT {literals(TECHNOLOGIES)}[CAST(p_partkey % 20 + 1 AS INT)])) AS tech_stack,
                list_sort(array_agg(DISTINCT {literals(SKILLS)}[CAST(p_partkey % 7 + 1 AS INT)])) AS skills,
                list_sort(array_agg(DISTINCT concat('scale ', lower(p_type)))) AS pain_points
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
        ) lines ON o_orderkey = l_orderkey"""),
    "scraped_v": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS job_id, source AS company,
            CASE lang WHEN 'en' THEN 'greenhouse' WHEN 'fr' THEN 'lever' WHEN 'de' THEN 'ashby' ELSE 'smartrecruiters' END AS ats,
            concat('Opening ', doc_id, ' at ', source) AS title, concat('https://jobs.example.com/', source, '/', doc_id) AS url,
            CASE WHEN doc_id % 9 <> 0 THEN concat('City_', doc_id % 37) END AS location,
            CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS description
        FROM documents"""),
    "changes_v": ([], f"""
        SELECT concat(o_orderkey, CASE WHEN l_linenumber > 4 THEN concat('-', l_linenumber) ELSE '' END) AS job_id,
            concat(CASE WHEN l_linenumber > 6 THEN 'branch_' ELSE 'company_' END, cno) AS company, {_ATS_OF} AS ats,
            concat('line ', l_linenumber, ' of part ', l_partkey) AS title,
            CASE WHEN l_returnflag <> 'N' THEN concat('https://jobs.example.com/supplier_', l_suppkey) END AS url,
            concat('City_', l_suppkey % 37) AS location,
            concat('quantity ', CAST(l_quantity AS INT), ' flag ', l_returnflag) AS raw_description,
            CAST(l_shipdate AS TIMESTAMP) AS scraped_at, l_partkey, l_suppkey, l_linenumber AS pos,
            CASE WHEN l_discount > 0.02 THEN 'Engineering' WHEN l_discount > 0 THEN 'Sales' END AS department,
            CASE l_linestatus WHEN 'F' THEN 'Senior' END AS seniority,
            CASE WHEN l_tax > 0.02 THEN ['python', 'go'] WHEN l_tax > 0 THEN CAST([] AS VARCHAR[]) END AS tech_stack,
            ['sql'] AS skills, CAST([] AS VARCHAR[]) AS pain_points,
            CASE l_returnflag WHEN 'R' THEN 'Remote' END AS remote_policy,
            CAST(l_quantity AS INT) * 1000 AS salary_min, CAST(NULL AS INT) AS salary_max,
            CAST(l_linenumber AS INT) AS experience_years, concat('ships ', l_suppkey) AS job_summary
        FROM (SELECT *, o_custkey % (1 + o_orderkey % 200) AS cno FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l"""),
    "latest_changes": (["changes_v"], """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY ats, company, job_id
                    ORDER BY scraped_at DESC, l_partkey DESC, l_suppkey DESC, pos DESC) AS place,
                min(scraped_at) OVER (PARTITION BY ats, company, job_id) AS first_scraped
            FROM changes_v) WHERE place = 1"""),
    "good_parts": ([], """
        SELECT *, CAST(2 * p_partkey AS VARCHAR) AS a, CAST(2 * p_partkey + 1 AS VARCHAR) AS b, concat('board', p_partkey) AS slug
        FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0"""),
    "greenhouse_v": (["good_parts"], """
        SELECT 'greenhouse' AS ats, slug, a AS id, p_name AS title, p_brand AS location,
            concat('https://boards.greenhouse.io/', slug, '/jobs/', a) AS url, concat(p_type, chr(10), 'Size ', p_size) AS description
        FROM good_parts
        UNION ALL SELECT 'greenhouse', slug, b, concat(p_name, ' lead'), '',
            concat('https://boards.greenhouse.io/', slug, '/jobs/', b), concat('R&amp;D ', p_type) FROM good_parts"""),
    "lever_v": (["good_parts"], """
        SELECT 'lever' AS ats, slug, a AS id, p_name AS title, p_brand AS location,
            concat('https://lever.example.com/', a) AS url, p_type AS description FROM good_parts WHERE p_size <> 50
        UNION ALL SELECT 'lever', slug, b, concat(p_name, ' lead'), '', '', '' FROM good_parts WHERE p_size <> 50"""),
    "ashby_v": (["good_parts"], """
        SELECT 'ashby' AS ats, slug, a AS id, p_name AS title, p_brand AS location,
            concat('https://ashby.example.com/', a) AS url, p_type AS description FROM good_parts
        UNION ALL SELECT 'ashby', slug, b, concat(p_name, ' lead'), '', concat('https://jobs.ashbyhq.com/', slug, '/', b), ''
        FROM good_parts"""),
    "smartrecruiters_v": (["good_parts"], """
        SELECT 'smartrecruiters' AS ats, slug, a AS id, p_name AS title, p_brand AS location,
            concat('https://jobs.smartrecruiters.com/', slug, '/', a) AS url, '' AS description FROM good_parts
        UNION ALL SELECT 'smartrecruiters', slug, b, concat(p_name, ' lead'), '',
            concat('https://jobs.smartrecruiters.com/', slug, '/', b), '' FROM good_parts"""),
    "sections_v": (["good_parts"], """
        SELECT 'smartrecruiters' AS ats, slug, a AS id, p_name AS title, p_brand AS location,
            concat('https://jobs.smartrecruiters.com/', slug, '/', a) AS url,
            concat('## The job', chr(10), chr(10), p_type, chr(10), 'size ', p_size, chr(10), chr(10), p_name, chr(10), chr(10),
                '## About', chr(10), chr(10), p_brand, chr(10), '& co') AS description FROM good_parts
        UNION ALL SELECT 'smartrecruiters', slug, b, concat(p_name, ' lead'), '',
            concat('https://jobs.smartrecruiters.com/', slug, '/', b), '' FROM good_parts"""),
    "records_v": (["greenhouse_v", "lever_v", "ashby_v", "sections_v"], """
        SELECT * FROM greenhouse_v UNION ALL SELECT * FROM lever_v UNION ALL SELECT * FROM ashby_v
        UNION ALL SELECT * FROM sections_v"""),
    "candidates_v": ([], f"""
        SELECT c_custkey AS candidate_id, coalesce(terms, CAST([] AS VARCHAR[])) AS terms, {_LEVEL} AS level,
            {_DEPARTMENT} AS department,
            CASE WHEN c_nationkey % 3 <> 0 THEN {_DEPARTMENT} END AS want_department,
            CASE WHEN c_nationkey % 2 = 0 THEN coalesce({_LEVEL}, '') ELSE '' END AS want_seniority,
            concat(c_name, ', ', lower(c_mktsegment), '. Knows: ', coalesce(array_to_string(terms, ', '), 'nothing yet')) AS text
        FROM customer LEFT JOIN (
            SELECT o_custkey, list_sort(list_distinct(list_concat(array_agg(DISTINCT {literals(TECHNOLOGIES)}[CAST(o_orderkey % 20 + 1 AS INT)]),
                array_agg(DISTINCT {literals(SKILLS)}[CAST(o_orderkey % 7 + 1 AS INT)])))) AS terms
            FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey"""),
    "listed_v": ([], "SELECT o_custkey AS candidate_id, CAST(o_orderkey + 1 AS BIGINT) AS id FROM orders"),
    "registry_v": ([], """
        SELECT CAST(s_suppkey AS INT) AS position, CASE WHEN s_acctbal >= 1000 THEN s_name END AS name,
            CASE WHEN s_nationkey = 3 THEN NULL ELSE ['greenhouse', 'lever', 'ashby', 'smartrecruiters'][CAST(s_suppkey % 4 + 1 AS INT)] END AS ats,
            CASE WHEN s_nationkey = 7 THEN '' ELSE concat('company_', 2 * s_suppkey) END AS slug
        FROM supplier"""),
    # What the replies of match_replies_v say, stated without reading the JSON.
    "match_items": ([], """
        SELECT o_custkey AS candidate_id, CAST(CASE WHEN o_orderkey % 19 = 0 THEN -1 - o_orderkey ELSE o_orderkey + 1 END AS BIGINT) AS job_id,
            CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS match_score,
            CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'sql|go' END AS matching_skills,
            CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'rust' END AS missing_skills,
            CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('fits ', o_orderstatus) END AS summary, o_orderkey
        FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 11 <> 0"""),
}


def using(*names: str) -> str:
    """``WITH`` clause for the named views and those they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for other in VIEWS[name][0]:
                add(other)
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed) + "\n"
