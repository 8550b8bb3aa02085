"""Declared schemas and fixed value lists; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_STRS = T.ArrayType(_STR)

# Column names, enumerations and messages users' queries depend on.
# Most selective first: sorts compare a prefix of the first key before anything else.
KEY = ["job_id", "company", "ats"]
PROFILE_KEY = ["company", "ats"]
JOB_FIELDS = [
    "id", "job_id", "company", "ats", "title", "location", "department", "seniority",
    "tech_stack", "skills", "pain_points", "remote_policy", "salary_min", "salary_max",
    "experience_years", "job_summary", "url",
]
DEPARTMENTS = [
    "Engineering", "Sales", "Marketing", "Finance", "HR", "Design", "Product", "Operations",
    "Legal", "Customer Success", "Other",
]
SENIORITIES = [
    "Intern", "Junior", "Mid", "Senior", "Lead", "Staff", "Principal", "Manager", "Director",
    "VP", "C-Level",
]
REMOTE_POLICIES = ["Remote", "Hybrid", "Onsite", "Unknown"]
NO_DESCRIPTION = "No description"
BAD_REPLY = "Failed to parse LLM response"
BAD_PAYLOAD = "API request failed"
UNKNOWN_ATS = "Unknown ATS: "
MAX_DESCRIPTION, MIN_DESCRIPTION = 8000, 100
MAX_RESUME, MAX_POSTINGS_BLOCK = 8000, 12000
BATCH_SIZE = 10

EXTRACTED_SCALARS = {
    "department": "string", "seniority": "string", "job_summary": "string", "remote_policy": "string",
    "salary_min": "int", "salary_max": "int", "experience_years": "int",
}
EXTRACTED_ARRAYS = ["tech_stack", "skills", "pain_points"]

JOBS = T.StructType([
    T.StructField("id", _LONG, False),
    T.StructField("job_id", _STR, False),
    T.StructField("company", _STR, False),
    T.StructField("ats", _STR, False),
    T.StructField("title", _STR, False),
    T.StructField("url", _STR),
    T.StructField("location", _STR),
    T.StructField("department", _STR),
    T.StructField("seniority", _STR),
    T.StructField("tech_stack", _STRS),
    T.StructField("skills", _STRS),
    T.StructField("pain_points", _STRS),
    T.StructField("remote_policy", _STR),
    T.StructField("salary_min", _INT),
    T.StructField("salary_max", _INT),
    T.StructField("experience_years", _INT),
    T.StructField("job_summary", _STR),
    T.StructField("raw_description", _STR),
    T.StructField("scraped_at", T.TimestampNTZType()),
    T.StructField("parsed_at", T.TimestampNTZType()),
])

# Column widths of the relational schema (only the bounded text columns).
MAX_LENGTHS = {
    "job_id": 100, "company": 255, "ats": 50, "title": 500, "location": 255,
    "department": 100, "seniority": 50, "remote_policy": 50,
}
REQUIRED = ["job_id", "company", "ats", "title"]

SCRAPED_POSTING = T.StructType([
    T.StructField(name, _STR) for name in ("id", "title", "location", "url", "description")
])
SCRAPED_FILE = T.StructType([
    T.StructField("company", _STR),
    T.StructField("slug", _STR),
    T.StructField("ats", _STR),
    T.StructField("jobs_count", _INT),
    T.StructField("jobs", T.ArrayType(SCRAPED_POSTING)),
    T.StructField("scraped_at", _STR),
])

EXTRACTED_POSTING = T.StructType(
    [T.StructField(n, _STR) for n in ("job_id", "title", "company", "location", "url")]
    + [T.StructField(n, _INT if t == "int" else _STR) for n, t in EXTRACTED_SCALARS.items()]
    + [T.StructField(n, _STRS) for n in EXTRACTED_ARRAYS]
    + [T.StructField("error", _STR)]
)
EXTRACTED_FILE = T.StructType([
    T.StructField("company", _STR),
    T.StructField("ats", _STR),
    T.StructField("batch_id", _INT),
    T.StructField("total_jobs", _INT),
    T.StructField("extracted", _INT),
    T.StructField("errors", _INT),
    T.StructField("jobs", T.ArrayType(EXTRACTED_POSTING)),
])


def _ranked(name: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, _STR), T.StructField("count", _LONG)]))


PROFILE_FILE = T.StructType([
    T.StructField("total_jobs", _INT),
    T.StructField("jobs_parsed", _INT),
    T.StructField("parse_rate", _DOUBLE),
    T.StructField("departments", T.MapType(_STR, _LONG)),
    T.StructField("seniority", T.MapType(_STR, _LONG)),
    T.StructField("tech_stack", _ranked("tech")),
    T.StructField("skills", _ranked("skill")),
    T.StructField("pain_points", _ranked("pain_point")),
    T.StructField("hiring_signals", _STRS),
])

MATCH_FIELDS = {
    "job_id": "bigint", "match_score": "double", "matching_skills": "array<string>", "missing_skills": "array<string>",
    "summary": "string",
}
