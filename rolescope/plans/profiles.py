"""Company profiles built from the jobs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import no_terms
from ..operators.keyed_table import KeyedTable
from ..schemas import PROFILE_KEY
from ..session import stored
from .reports import LEADERSHIP, percent, signals

TOP_TERMS = 20
# Profile column -> posting column, and for term lists the name of a term in the profile.
BREAKDOWNS = {"departments": "department", "seniority_breakdown": "seniority"}
TERM_LISTS = {
    "top_tech_stack": ("tech_stack", "tech"),
    "top_skills": ("skills", "skill"),
    "top_pain_points": ("pain_points", "pain_point"),
}


def _breakdown_counts(jobs: DataFrame) -> DataFrame:
    """Postings per value of each breakdown; the NULL value is kept, it counts the unparsed postings."""
    combinations = jobs.groupBy(*PROFILE_KEY, *BREAKDOWNS.values()).agg(F.count("*").alias("n"))
    entries = F.explode(F.array(*[
        F.struct(F.lit(p).alias("dimension"), F.col(c).alias("value")) for p, c in BREAKDOWNS.items()
    ]))
    tagged = combinations.select(*PROFILE_KEY, entries.alias("e"), "n")
    return tagged.groupBy(*PROFILE_KEY, "e.dimension", "e.value").agg(F.sum("n").alias("n"))


def _term_counts(jobs: DataFrame) -> DataFrame:
    """Occurrences of each term of each list of a company."""
    def tagged(dimension: str, terms: str) -> Column:
        return F.transform(
            F.coalesce(terms, no_terms()), lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value"))
        )

    entries = F.concat(*[tagged(p, c) for p, (c, _) in TERM_LISTS.items()])
    return (
        jobs.select(*PROFILE_KEY, F.explode(entries).alias("e"))
        .where("e.value IS NOT NULL")
        .groupBy(*PROFILE_KEY, "e.dimension", "e.value")
        .agg(F.count("*").alias("n"))
    )


def _top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of each list of a company; cut before anything is collected."""
    best = Window.partitionBy(*PROFILE_KEY, "dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def company_profiles(jobs: DataFrame, analyzed_at: Column | None = None, k: int = TOP_TERMS) -> DataFrame:
    """Totals, breakdowns, most frequent terms and hiring signals of each ``(ats, company)``."""
    return _profiles(_breakdown_counts(jobs).unionByName(_top_terms(_term_counts(jobs), k)), analyzed_at)


def _profiles(entries: DataFrame, analyzed_at: Column | None) -> DataFrame:
    """Profiles from counts per (company, dimension, value)."""
    dimension, value, n = F.col("dimension"), F.col("value"), F.col("n")

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    def breakdown(name: str) -> Column:
        pairs = F.collect_list(F.when((dimension == name) & value.isNotNull(), F.struct(value, n)))
        return F.map_from_entries(F.array_sort(pairs))

    def ranked(name: str, term: str) -> Column:
        best_first = F.array_sort(F.collect_list(F.when(dimension == name, F.struct((-n).alias("m"), value))))
        return F.transform(best_first, lambda e: F.struct(e["value"].alias(term), (-e["m"]).alias("count")))

    by_department = dimension == "departments"
    grouped = entries.groupBy(*PROFILE_KEY).agg(
        counted(by_department).alias("job_count"),
        counted(by_department & value.isNotNull()).alias("parsed"),
        counted(by_department & (value == "Engineering")).alias("eng_count"),
        counted(by_department & (value == "Sales")).alias("sales_count"),
        counted((dimension == "seniority_breakdown") & value.isin(LEADERSHIP)).alias("senior_count"),
        *[breakdown(p).alias(p) for p in BREAKDOWNS],
        *[ranked(p, term).alias(p) for p, (_, term) in TERM_LISTS.items()],
    )
    stamp = F.localtimestamp() if analyzed_at is None else analyzed_at
    return grouped.select(
        "company", "ats",
        F.col("job_count").cast("int").alias("total_jobs"),
        F.col("parsed").cast("int").alias("jobs_parsed"),
        percent(F.col("parsed"), F.col("job_count")).alias("parse_rate"),
        *BREAKDOWNS, *TERM_LISTS,
        signals().alias("hiring_signals"),
        stamp.cast("timestamp_ntz").alias("analyzed_at"),
    )


# Counts that are kept up: NULL, the value of unparsed postings, is a key like any other.
COUNT_KEY = [*PROFILE_KEY, "dimension", "value", "known"]


def value_counts(jobs: DataFrame) -> DataFrame:
    """``COUNT_KEY`` and n: what profiles are made of, one row per company, dimension and value."""
    rows = _breakdown_counts(jobs).unionByName(_term_counts(jobs))
    return rows.select(*PROFILE_KEY, "dimension", F.coalesce("value", F.lit("")).alias("value"), F.col("value").isNotNull().alias("known"), "n")


def create_counts(jobs: DataFrame, path: str, buckets: int = 256) -> KeyedTable:
    """The counts of all postings as a keyed table."""
    return KeyedTable.create(value_counts(jobs), path, COUNT_KEY, buckets)


def apply_changes(counts: KeyedTable, before: DataFrame, after: DataFrame) -> KeyedTable:
    """The counts once the postings ``before`` have been replaced by ``after``: the rows that a batch inserts are in ``after`` only, those it
    deletes in ``before`` only, those it changes in both, as they were and as they are.

    Each posting adds one to its values or takes one away; what does not change cancels out. Work follows the batch, and the buckets that hold
    its values; the other postings are not read.
    """
    signed = value_counts(after).unionByName(value_counts(before).withColumn("n", -F.col("n")))
    delta = stored(signed.groupBy(*COUNT_KEY).agg(F.sum("n").alias("change")).where("change <> 0"), "signed-counts")
    held = counts.lookup(delta)
    changed = stored(delta.join(held, COUNT_KEY, "left").select(*COUNT_KEY, (F.coalesce("n", F.lit(0)) + F.col("change")).alias("n")), "changed-counts")
    following = counts.merge(changed, ["n"])
    return following.remove(gone) if not (gone := changed.where("n <= 0")).isEmpty() else following


def profiles_of_counts(counts: KeyedTable, analyzed_at: Column | None = None, k: int = TOP_TERMS) -> DataFrame:
    """``company_profiles`` from the counts alone; no posting is read."""
    rows = counts.read().withColumn("value", F.when(F.col("known"), F.col("value"))).drop("known")
    terms = F.col("dimension").isin(list(TERM_LISTS))
    return _profiles(rows.where(~terms).unionByName(_top_terms(rows.where(terms), k)), analyzed_at)
