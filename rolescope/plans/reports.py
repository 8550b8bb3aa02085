"""Aggregate reports. Each is one pass with partial sums in the map tasks, so a company with a third of
all postings sends a handful of rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import contains_text, job_filters

# Signal names and thresholds.
LEADERSHIP = ["Senior", "Staff", "Principal"]
SIGNALS = [
    ("aggressive_hiring", "job_count", 50),
    ("scaling_engineering", "eng_count", 10),
    ("gtm_expansion", "sales_count", 5),
    ("building_leadership", "senior_count", 5),
]
AI_TERMS = ["ml", "deep-learning", "nlp", "cv", "llm", "genai"]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 for an empty whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


def stats_totals(jobs: DataFrame) -> DataFrame:
    """Postings, parsed postings, companies and parse rate.

    Counted per company first; a plain count-distinct beside other counts would shuffle in the same way.
    """
    per_company = jobs.groupBy("company").agg(F.count("*").alias("n"), F.count("department").alias("parsed"))
    total, parsed = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("parsed"), F.lit(0))
    return per_company.agg(
        total.alias("total_jobs"), parsed.alias("parsed_jobs"), F.count("company").alias("total_companies"),
    ).withColumn("parse_rate", percent(F.col("parsed_jobs"), F.col("total_jobs")))


def count_by(rows: DataFrame, column: str, name: str = "count") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(name))


def top_counts(rows: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Values by falling count, ties by value."""
    ordered = count_by(rows, column).orderBy(F.desc("count"), F.asc_nulls_last(column))
    return ordered if k is None else ordered.limit(k)


def stats_by_ats(jobs: DataFrame) -> DataFrame:
    return top_counts(jobs, "ats")


def stats_top_departments(jobs: DataFrame, k: int = 10) -> DataFrame:
    return top_counts(jobs.where("department IS NOT NULL"), "department", k)


def _technologies(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.explode("tech_stack").alias("tech"))


def tech_trends(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The most common technologies; a NULL inside a list counts as its own group."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return top_counts(_technologies(jobs), "tech", limit)


def facet_values(jobs: DataFrame) -> DataFrame:
    """Distinct departments, seniorities and remote policies, in one pass over the postings."""
    columns = ["department", "seniority", "remote_policy"]
    combinations = jobs.select(*columns).distinct()
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return (
        combinations.select(facets.alias("f")).select("f.*").where("value IS NOT NULL")
        .distinct().orderBy("facet", "value")
    )


def facet_counts(jobs: DataFrame, **filters) -> DataFrame:
    """Postings per department, seniority and remote policy among those that pass the filters of a search.

    Reduced to combinations of the three first, so one pass and a small shuffle count all facets.
    """
    columns = ["department", "seniority", "remote_policy"]
    combinations = jobs.where(job_filters(**filters)).groupBy(*columns).agg(F.count("*").alias("n"))
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return combinations.select(facets.alias("f"), "n").where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(
        F.sum("n").alias("count")).orderBy("facet", F.desc("count"), "value")


def monthly_trends(jobs: DataFrame) -> DataFrame:
    """Per month of scraping and department: postings, mean pay range, and the change in postings since the department's
    month before. One row per month and department enters the window, whatever the number of postings."""
    month = F.date_trunc("month", "scraped_at").cast("date").alias("month")
    counts = jobs.where("scraped_at IS NOT NULL").groupBy(month, "department").agg(
        F.count("*").alias("postings"),
        F.round(F.sum(F.col("salary_min").cast("bigint")) / F.count("salary_min"), 2).alias("mean_salary_min"),
        F.round(F.sum(F.col("salary_max").cast("bigint")) / F.count("salary_max"), 2).alias("mean_salary_max"),
    )
    before = F.lag("postings").over(Window.partitionBy("department").orderBy("month"))
    return counts.withColumn("change", F.col("postings") - before)


def pay_percentiles(jobs: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), column: str = "salary_min") -> DataFrame:
    """Per month of scraping and department: postings with pay, and the exact percentiles of it, interpolated between neighbours; ``p25``, ``p50`` and so on.

    Pay is counted per (month, department, amount) first. What an aggregate holds is then a department's distinct amounts, whatever the number of postings.
    """
    month = F.date_trunc("month", "scraped_at").cast("date").alias("month")
    paid = jobs.where(f"scraped_at IS NOT NULL AND {column} IS NOT NULL")
    amounts = paid.groupBy(month, "department", F.col(column).alias("amount")).agg(F.count("*").alias("n"))
    ranks = F.percentile("amount", F.array(*[F.lit(s) for s in shares]), F.col("n")).alias("ranks")
    rows = amounts.groupBy("month", "department").agg(F.sum("n").alias("postings"), ranks)
    return rows.select("month", "department", "postings", *[F.round(F.col("ranks")[i], 2).alias(f"p{s * 100:g}") for i, s in enumerate(shares)])


def facet_tech(jobs: DataFrame, k: int = 50) -> DataFrame:
    return top_counts(_technologies(jobs), "tech", k)


def _company_groups(jobs: DataFrame) -> DataFrame:
    """Per ``(company, ats)``: counts and distinct values, from postings reduced to value combinations first."""
    combinations = jobs.groupBy("company", "ats", "department", "seniority").agg(F.count("*").alias("n"))

    def distinct_values(column: str) -> Column:
        values = F.array_sort(F.collect_set(column))
        return F.when(F.size(values) > 0, values)

    return combinations.groupBy("company", "ats").agg(
        F.sum("n").alias("job_count"),
        F.coalesce(F.sum(F.when(F.col("department").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed_jobs"),
        distinct_values("department").alias("departments"),
        distinct_values("seniority").alias("seniorities"),
    )


def _matching(jobs: DataFrame, search: str | None) -> DataFrame:
    return jobs.where(contains_text(F.col("company"), search)) if search else jobs


def companies(
    jobs: DataFrame, search: str | None = None, min_jobs: int = 1, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Companies by falling number of postings, with the values seen in their postings."""
    return (
        _company_groups(_matching(jobs, search)).drop("parsed_jobs").where(F.col("job_count") >= min_jobs)
        .orderBy(F.desc("job_count"), "company", "ats").offset(offset).limit(limit)
    )


def companies_total(jobs: DataFrame, search: str | None = None, min_jobs: int = 1) -> DataFrame:
    groups = _matching(jobs, search).groupBy("company", "ats").count().where(F.col("count") >= min_jobs)
    return groups.agg(F.count("*").alias("total"))


def company_detail(jobs: DataFrame, name: str) -> DataFrame:
    """Summary of each company whose name holds ``name``."""
    groups = _company_groups(jobs.where(contains_text(F.col("company"), name)))
    return groups.withColumnRenamed("job_count", "total_jobs")


def company_tech(jobs: DataFrame, name: str, k: int = 20) -> DataFrame:
    return top_counts(_technologies(jobs.where(contains_text(F.col("company"), name))), "tech", k)


def company_breakdown(jobs: DataFrame, name: str, column: str) -> DataFrame:
    """Postings of a company by department or seniority."""
    rows = jobs.where(contains_text(F.col("company"), name) & F.col(column).isNotNull())
    return top_counts(rows, column)


def hiring_counts(jobs: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("job_count"),
        F.count_if(F.col("department") == "Engineering").alias("eng_count"),
        F.count_if(F.col("department") == "Sales").alias("sales_count"),
        F.count_if(F.col("seniority").isin(LEADERSHIP)).alias("senior_count"),
    )


def signals() -> Column:
    """Names of the signals whose threshold a counted row reaches, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(c) >= least, F.lit(name)) for name, c, least in SIGNALS]))


def hiring_signals(jobs: DataFrame, min_jobs: int = 10, k: int = 50) -> DataFrame:
    """The companies that hire most, with their signals."""
    return (
        hiring_counts(jobs, ["company"]).where(F.col("job_count") >= min_jobs)
        .orderBy(F.desc("job_count"), "company").limit(k).withColumn("signals", signals())
    )


def signal_ai_ml(jobs: DataFrame, normalized_tech: Column, least: int = 5) -> DataFrame:
    """Companies with at least ``least`` postings that ask for machine learning in some form."""
    overlap = F.arrays_overlap(normalized_tech, F.array(*[F.lit(t) for t in AI_TERMS]))
    hits = jobs.groupBy("company").agg(F.count_if(overlap).alias("ai_ml_jobs"))
    return hits.where(F.col("ai_ml_jobs") >= least)


def scrape_summary(
    postings: DataFrame, description: str = "description", companies: DataFrame | None = None
) -> DataFrame:
    """Per system and in total: companies, postings, postings with a description, and their share.

    Postings are counted per company first; the roll-up then works on one row per company. With
    ``companies`` (``ats, company``, each once) those without postings are counted too.
    """
    per_company = postings.groupBy("ats", "company").agg(
        F.count("*").alias("n"), F.count_if(F.length(description) > 0).alias("filled")
    )
    if companies is not None:
        per_company = companies.join(per_company, ["ats", "company"], "left").na.fill(0, ["n", "filled"])
    rolled = per_company.rollup("ats").agg(
        F.grouping("ats").alias("is_total"),
        F.count("*").alias("companies"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("with_desc"),
    )
    return rolled.select(
        F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("ats")).alias("ats"),
        "companies", "jobs", "with_desc",
        F.round(100.0 * F.col("with_desc") / F.greatest(F.col("jobs"), F.lit(1)), 1).alias("rate"),
        F.col("is_total").cast("int").alias("is_total"),
    ).orderBy("is_total", "ats")
