"""URL filters by pattern rules that are indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

TOKEN = "[a-z0-9]+"
RULES = "name string, verdict string, pattern string, literals array<string>, rank int"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the address (host and path). ``literals`` are whole lower-case tokens that stand in the address
    wherever the pattern fits. Of the rules that fit, the highest ``rank`` wins, then the longest ``name``, then the
    greatest name."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = 0


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains, below a path."""
    whole_tokens = re.findall(TOKEN, host) + [
        t.lower() for t in re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9]|$)", path)
    ]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys(whole_tokens)), rank=1)


# The rules of the contract.
SITE_RULES = [
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
]
# What decides where no site rule fits: addresses that hold no running text. Everything else is allowed.
PATTERN_RULES = [
    Rule("advert", "block", r"/advert(?:/|\z)", ("advert",)),
    Rule("adserver", "block", r"(?:^|\.)adserver\.", ("adserver",)),
    Rule("login", "block", r"/wp-login\.php\z", ("wp", "login", "php")),
    Rule("casino", "block", r"(?:^|[.-])casino[.-]", ("casino",)),
    Rule("zip", "block", r"(?i)\.zip\z", ("zip",)),
    Rule("exe", "block", r"(?i)\.exe\z", ("exe",)),
]


def _lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def token_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with the one of its literals that the fewest addresses hold; ties go to the smaller token.

    ``tokens`` has one row per address and token. Only tokens of rules are counted.
    """
    wanted = rules.select("name", F.explode("literals").alias("token"))
    found = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rated = wanted.join(found, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = rated.groupBy("name").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    return rules.join(rarest, "name")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A list of rules as the table that ``judge_urls`` takes, too."""
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.literals), r.rank) for r in rules], RULES)


def candidates(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules whose rarest literal an address holds, per row of ``tokens``. A literal that many rules share brings them to an address only if
    each of these rules has no rarer one."""
    return tokens.join(token_index(rules, tokens), "token")


def judge_urls(urls: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """Judge the distinct values of column ``url``: returns url, host, path, rule, verdict, by_rank.

    ``rules`` may be a table of any size: name, verdict, pattern, literals and rank, as the fields of ``Rule``; each name once. A rule without literals is refused.

    Equal addresses (host and path) are judged once, so a hot address is one row. The tokens of an address fetch the rules
    indexed by them; only those run their pattern. An address without a fitting rule gets ``default`` and a null rule.
    A null url is one of the values.
    """
    listed = rules if isinstance(rules, DataFrame) else rule_table(urls.sparkSession, rules)
    for rule in listed.where(F.coalesce(F.array_size("literals"), F.lit(0)) == 0).select("name").limit(1).collect():
        raise ValueError(f"rule {rule.name} has no literal token to index it by")
    host, path = url_parts(F.col("url"))
    parts = urls.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    addresses = parts.select("host", "path").distinct()
    spelled = F.array_distinct(F.regexp_extract_all(_lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))
    tokens = addresses.select("host", "path", F.explode(spelled).alias("token"))
    fitting = candidates(tokens, listed).where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    order = F.struct("rank", F.length("name"), "name")
    best = fitting.groupBy("host", "path").agg(
        F.max_by(F.struct(F.col("name").alias("rule"), "verdict", "rank"), order).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.rank").alias("by_rank"),
    )


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` with a struct column ``judged`` (host, path, rule, verdict); ``rule`` names a site rule only.

    Rows are joined by the url itself: repeated rows, null ids and null urls all get a verdict. A column of
    ``pages`` that is named ``judged`` is replaced. A url that fills a third of the rows is one row on the judged
    side, and AQE splits its rows on the other.
    """
    verdicts = judge_urls(pages.select(F.col(url).alias("url")), SITE_RULES + PATTERN_RULES if rules is None else rules, default)
    judged = verdicts.select(
        F.col("url").alias("_judged_url"),
        F.struct("host", "path", F.when(F.col("by_rank") > 0, F.col("rule")).alias("rule"), "verdict").alias("judged"),
    )
    joined = pages.join(judged, pages[url].eqNullSafe(judged["_judged_url"]), "left")
    return joined.select(*[pages[c] for c in pages.columns if c != "judged"], judged["judged"])
