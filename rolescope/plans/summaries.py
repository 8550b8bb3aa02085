"""Mergeable summaries of the postings, one per company and day, from which any span of days is put together.

Two tables below ``path``, in folders by day: ``daily`` has per (day, company, system) the postings, the parsed ones and sketches of the distinct titles
and technologies; ``terms`` the exact counts of (day, company, dimension, value). A day is written once, or again as a whole, and costs that day's postings; a span
reads the folders of its days and no posting. Counts are exact. Distinct numbers are estimates whose relative standard error is
``error(lg_k)``; ``exact_span`` answers the same from the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
DIMENSIONS = ("department", "seniority", "remote_policy")
_DAILY = "company string, ats string, postings long, parsed long, titles binary, technologies binary, day date"
_TERMS = "company string, dimension string, value string, n long, day date"


def error(lg_k: int = LG_K) -> float:
    """The relative standard error of an estimate from sketches of 2^lg_k slots."""
    return 1.04 / (1 << lg_k) ** 0.5


def _day(unit: str) -> Column:
    return F.date_trunc(unit, "scraped_at").cast("date").alias("day")


def daily(jobs: DataFrame, lg_k: int = LG_K, unit: str = "day") -> DataFrame:
    """One row per day of scraping, company and system. Postings without a stamp are of no day and go under a NULL day.

    Sketches are made in the map tasks, so a company with a third of all postings sends one row per task. Lists
    of technologies are sketched apart from the postings, as a posting would count once per technology otherwise.
    """
    keys = [_day(unit), "company", "ats"]
    rows = jobs.groupBy(*keys).agg(
        F.count("*").alias("postings"), F.count("department").alias("parsed"), F.hll_sketch_agg("title", lg_k).alias("titles"))
    used = jobs.select(*keys, F.explode("tech_stack").alias("tech")).groupBy("day", "company", "ats").agg(F.hll_sketch_agg("tech", lg_k).alias("technologies"))
    left, right = rows.alias("l"), used.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("day", "company", "ats")]
    return left.join(right, same, "left").select("l.company", "l.ats", "postings", "parsed", "titles", "technologies", "l.day")


def term_counts(jobs: DataFrame, unit: str = "day") -> DataFrame:
    """Exact counts of each value of the ``DIMENSIONS`` and of each technology, per day and company; values that are NULL are left out.

    Postings are reduced to combinations of the dimensions first.
    """
    keys = [_day(unit), "company"]
    combined = jobs.groupBy(*keys, *DIMENSIONS).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    single = combined.select("day", "company", "n", pairs.alias("p")).select("day", "company", "p.dimension", "p.value", "n")
    listed = jobs.select(*keys, F.lit("tech_stack").alias("dimension"), F.explode("tech_stack").alias("value"), F.lit(1).cast("long").alias("n"))
    both = single.unionByName(listed).where("value IS NOT NULL")
    return both.groupBy("company", "dimension", "value", "day").agg(F.sum("n").alias("n"))


def write_days(jobs: DataFrame, path: str, lg_k: int = LG_K, unit: str = "day") -> None:
    """Summarize all days that ``jobs`` holds, which must hold these days' postings in full. Days that were written before are replaced, others stay.
    With another ``unit``, such as ``month``, a day stands for the unit that it begins."""
    for name, rows in (("daily", daily(jobs, lg_k, unit)), ("terms", term_counts(jobs, unit))):
        rows.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path.rstrip('/')}/{name}")


def _span(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``; without bounds also those of no day."""
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col("day") <= F.lit(last).cast("date"))


def read_daily(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return _span(spark.read.schema(_DAILY).parquet(f"{path.rstrip('/')}/daily"), first, last)


def read_terms(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    return _span(spark.read.schema(_TERMS).parquet(f"{path.rstrip('/')}/terms"), first, last)


def _estimate(sketches: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketches)), F.lit(0))


def span_totals(days: DataFrame, *by: str) -> DataFrame:
    """Postings, parsed postings, companies, and estimates of the distinct titles and technologies, of the days of ``read_daily``;
    in groups of the columns ``by``, if given."""
    return days.groupBy(*by).agg(
        F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("parsed"),
        F.count_distinct("company").alias("companies"), _estimate("titles").alias("titles"), _estimate("technologies").alias("technologies"))


def exact_span(jobs: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """``span_totals`` without groups, exactly and from the postings. Each distinct number has an aggregation of its own."""
    rows = _span(jobs.withColumn("day", _day("day")), first, last)
    counts = rows.agg(F.count("*").alias("postings"), F.count("department").alias("parsed"), F.count_distinct("company").alias("companies"))
    titles = rows.agg(F.count_distinct("title")).scalar()
    technologies = rows.select(F.explode("tech_stack").alias("tech")).agg(F.count_distinct("tech")).scalar()
    return counts.withColumns({"titles": titles, "technologies": technologies})


def span_terms(terms: DataFrame, dimension: str, k: int | None = None, company: str | None = None) -> DataFrame:
    """The values of a dimension by falling count, ties by value, over the days of ``read_terms``; of one company, if given."""
    rows = terms.where(F.col("dimension") == dimension)
    if company is not None:
        rows = rows.where(F.col("company") == company)
    counted = rows.groupBy("value").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "value")
    return counted if k is None else counted.limit(k)
