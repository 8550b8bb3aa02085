"""Extraction by rules, for runs without a model: dictionary terms, pay, years, remote words, level words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TECH, normalize_tech_stack
from ..schemas import SENIORITIES

WORD_BREAK = r"[^a-z0-9+#./-]+"
PAY = r"\$?(\d{2,3}),?(\d{3})"
YEARS = r"(\d+)\+? years"
LEVEL = r"(?i)\b(" + "|".join(SENIORITIES) + r")\b"
LONGEST_TERM = max(len(variant.split(" ")) for variant in TECH)


def _word_groups(words: Column, size: int) -> Column:
    """All runs of ``size`` neighbouring words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.coalesce(runs, F.array().cast("array<string>"))


def description_words(text: Column) -> Column:
    """Words of a text in lower case, without stops, slashes and hyphens at their end."""
    words = F.transform(F.split(F.lower(text), WORD_BREAK), lambda w: F.rtrim(w, F.lit("./-")))
    return F.filter(words, lambda w: w != "")


def found_terms(words: Column, dictionary: dict[str, str] = TECH) -> Column:
    """Canonical names of the dictionary spellings met in a text."""
    groups = F.concat(words, *[_word_groups(words, n) for n in range(2, LONGEST_TERM + 1)])
    return normalize_tech_stack(F.array_intersect(groups, F.array(*[F.lit(v) for v in dictionary])), dictionary)


def extract_by_rules(postings: DataFrame) -> DataFrame:
    """Add ``tech_stack, salary_min, salary_max, experience_years, remote_policy, seniority``."""
    text = F.lower("description")
    words = description_words(F.col("description"))
    digits = F.regexp_extract_all("description", F.lit(PAY), F.lit(0))
    pay = F.transform(digits, lambda d: F.regexp_replace(d, "[$,]", "").cast("int"))
    years = F.regexp_extract(text, YEARS, 1)
    level = F.lower(F.regexp_extract("title", LEVEL, 1))
    named = F.element_at(F.array(*[F.lit(s) for s in SENIORITIES]), F.array_position(
        F.array(*[F.lit(s.lower()) for s in SENIORITIES]), level).cast("int"))
    prepared = postings.withColumns({"_words": words, "_pay": pay})
    return prepared.withColumns({
        "tech_stack": found_terms(F.col("_words")),
        "salary_min": F.array_min("_pay"),
        "salary_max": F.array_max("_pay"),
        "experience_years": F.when(years != "", years.try_cast("int")),
        "remote_policy": F.when(text.contains("remote"), "Remote").when(text.contains("hybrid"), "Hybrid")
        .when(text.contains("onsite") | text.contains("on-site"), "Onsite").otherwise("Unknown"),
        "seniority": F.when(level != "", named),
    }).drop("_words", "_pay")
