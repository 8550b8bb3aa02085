"""Row rules: constraint checks and value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEPARTMENTS, KEY, MAX_LENGTHS, REMOTE_POLICIES, REQUIRED, SENIORITIES


def rule_reasons(required: list[str] = REQUIRED, max_lengths: dict[str, int] = MAX_LENGTHS) -> Column:
    """The broken rules of a row as a list, in rule order."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]
    rules += [F.when(F.length(c) > n, F.lit(f"{c} longer than {n}")) for c, n in max_lengths.items()]
    return F.array_compact(F.array(*rules))


def validate_jobs(jobs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Add ``reasons``; an empty list marks a valid row, the others go to quarantine.

    Repeated keys are counted with map-side partial sums, and only keys seen more than once are joined
    back. A hot repeated key meets one row of that side, and AQE splits the partition it fills.
    """
    repeated = jobs.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(True).alias("_repeated"))
    checked = jobs.join(repeated, keys, "left")
    duplicate = F.when(F.col("_repeated"), F.lit("duplicate key"))
    reasons = F.concat(rule_reasons(), F.array_compact(F.array(duplicate)))
    return checked.withColumn("reasons", reasons).drop("_repeated")


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.array_size("reasons") == 0).drop("reasons")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.array_size("reasons") > 0)


def value_flags() -> dict[str, Column]:
    """Whether the extracted enumerations hold a known value; NULL counts as known."""
    allowed = {"department": DEPARTMENTS, "seniority": SENIORITIES, "remote_policy": REMOTE_POLICIES}
    return {f"{c}_ok": F.col(c).isNull() | F.col(c).isin(*values) for c, values in allowed.items()}


def extract_quality(extracted: DataFrame) -> DataFrame:
    """Per system: rows, and rows with an unknown value in each enumeration."""
    flags = value_flags()
    return extracted.groupBy("ats").agg(
        F.count("*").alias("rows"),
        *[F.count_if(~flag).alias(name.replace("_ok", "_unknown")) for name, flag in flags.items()],
    )
