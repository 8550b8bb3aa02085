import pytest
from helpers import CLASHING
from pyspark.sql import functions as F

from rolescope.llm import url_filters
from rolescope.llm.url_filters import Rule, filter_urls, site_rule

URLS = [
    ("http://a.NET/x?y", "a.net", "/x", "net/", "block"), ("https://example.net/en/5#t", "example.net", "/en/5", "example.net/en/", "allow"),
    ("https://m.example.net/EN/5", "m.example.net", "/EN/5", "net/", "block"), ("https://notexample.net", "notexample.net", "", None, "allow"),
    ("https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), ("https://example.com/de", "example.com", "/de", None, "allow"),
    ("ftp://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"), ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.net/en/", "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("http://?q=http://a.net/", "", "", None, "allow"), ("http://h.net:80/", "h.net:80", "/", None, "allow"), ("http://ÄB.net/ü\n", "Äb.net", "/ü\n", "net/", "block"),
    ("https://x.io/a/file.ZIP", "x.io", "/a/file.ZIP", None, "block"), ("https://x.io/advert", "x.io", "/advert", None, "block"),
    ("https://x.io/adverts", "x.io", "/adverts", None, "allow"), ("http://a.net/" + "p" * 100_000, "a.net", "/" + "p" * 100_000, "net/", "block"),
]


def test_judged_by_hand(spark):
    rows = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(None, None), (0, URLS[0][0])], "page_id long, url string")
    judged = filter_urls(rows.withColumns({n: F.lit(v) for n, v in CLASHING.items()}))
    got = judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict").collect()
    assert {tuple(r) for r in got} == {(i, *u[1:]) for i, u in enumerate(URLS)} | {(None, "", "", None, "allow")} and len(got) == len(URLS) + 2
    assert set(judged.columns) == {"page_id", "url", *CLASHING}
    assert filter_urls(rows.limit(0)).count() == 0


def test_rarest_token_and_longest_rule(spark):
    rules = [Rule("a", "block", "common", ("common", "rare")), Rule("ab", "allow", "rare", ("rare",)), Rule("z", "block", "absent", ("absent", "common"))]
    urls = spark.createDataFrame([("http://common.rare/",), ("http://common.x/",), ("http://common.y/",)], "url string")
    host, path = url_filters.url_parts(F.col("url"))
    tokens = urls.select(F.explode(F.split(host, r"\.")).alias("token"))
    listed = spark.createDataFrame([(r.name, list(r.literals)) for r in rules], "name string, literals array<string>")
    assert {r.name: r.token for r in url_filters.token_index(listed, tokens).collect()} == {"a": "rare", "ab": "rare", "z": "absent"}
    # Rule a is indexed by "rare" only, as its literals must all stand in an address that it fits.
    got = {r.url: r.verdict for r in url_filters.judge_urls(urls, rules, "unknown").select("url", "verdict").collect()}
    assert got == {"http://common.rare/": "allow", "http://common.x/": "unknown", "http://common.y/": "unknown"}
    with pytest.raises(ValueError):
        url_filters.judge_urls(urls, [Rule("n", "block", ".", ())])
    assert site_rule("block", "ads.example.com", "/x/partial").literals == ("ads", "example", "com", "x")


def test_a_table_of_many_rules(spark):
    """100,000 rules that all hold the tokens ``com`` and ``www``, which all addresses hold: an address meets the rules of its own rare token only."""
    n = 100_000
    rules = spark.range(n).selectExpr(
        "concat('r', id) AS name", "IF(id % 2 = 0, 'block', 'allow') AS verdict", "concat('^www\\\\.site', id, '\\\\.com/') AS pattern",
        "array('www', concat('site', id), 'com') AS literals", "1 AS rank")
    urls = spark.range(0, n, 500).selectExpr("concat('http://www.site', id, IF(id % 1000 = 0, '.com/x', '.org/com')) AS url")
    got = url_filters.judge_urls(urls, rules, "unknown").collect()
    want = {f"http://www.site{i}{'.com/x' if i % 1000 == 0 else '.org/com'}": (f"r{i}", "block") if i % 1000 == 0 else (None, "unknown") for i in range(0, n, 500)}
    assert {r.url: (r.rule, r.verdict) for r in got} == want
    host, path = url_filters.url_parts(F.col("url"))
    tokens = urls.select("url", F.explode(F.array_distinct(F.regexp_extract_all(F.concat(host, path), F.lit(url_filters.TOKEN), F.lit(0)))).alias("token"))
    assert url_filters.candidates(tokens, rules).count() == urls.count()
    with pytest.raises(ValueError, match="r7"):
        url_filters.judge_urls(urls, rules.where("name = 'r7'").withColumn("literals", F.expr("CAST(NULL AS ARRAY<STRING>)")))


def test_no_python_in_the_plan(spark):
    plan = filter_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
