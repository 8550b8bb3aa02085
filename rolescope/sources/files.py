"""JSON document trees and the partitioned output.

Two layouts are read: one document per file (``multiline=True``, as scrapers save it), and one document
per line. A file of the first kind is one task however large it is; write line files for big companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType, VariantType

from ..functions.text import strip, truncate
from ..schemas import EXTRACTED_ARRAYS, EXTRACTED_FILE, EXTRACTED_SCALARS, MAX_RESUME, PROFILE_FILE, SCRAPED_FILE

def _path() -> Column:
    return F.col("_metadata.file_path")


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def path_ats() -> Column:
    """System name from ``.../{ats}/{company}.json`` or ``.../ats={ats}/company={company}/part.json``."""
    partitioned = F.regexp_extract(_path(), r"/ats=([^/]+)/", 1)
    plain = F.regexp_extract(_path(), r"/([^/]+)/[^/]+$", 1)
    return _decoded(F.when(partitioned != "", partitioned).otherwise(plain))


def path_company() -> Column:
    partitioned = F.regexp_extract(_path(), r"/company=([^/]+)/", 1)
    return _decoded(F.when(partitioned != "", partitioned).otherwise(file_stem()))


def file_stem() -> Column:
    return _decoded(F.regexp_extract(_path(), r"/([^/]+)\.json$", 1))


def _read(spark: SparkSession, path: str, schema, multiline: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", multiline)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def _or_blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def postings_of(documents: DataFrame) -> DataFrame:
    """Scraped documents with ``ats, company, file`` columns, one row per posting."""
    return documents.select(
        "ats", "company", "file", "scraped_at", F.posexplode("jobs").alias("pos", "job")
    ).select(
        _or_blank("job.id").alias("job_id"),
        "company", "ats",
        _or_blank("job.title").alias("title"),
        _or_blank("job.url").alias("url"),
        _or_blank("job.location").alias("location"),
        _or_blank("job.description").alias("raw_description"),
        F.col("scraped_at").try_cast("timestamp_ntz").alias("scraped_at"),
        "file", "pos",
    )


def scan_scraped(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Scraped postings; system and company come from the path, absent text becomes ''."""
    documents = _read(spark, path, SCRAPED_FILE, multiline).select(
        path_ats().alias("ats"), path_company().alias("company"), _path().alias("file"), "scraped_at", "jobs"
    )
    return postings_of(documents)


def scan_extracted(spark: SparkSession, path: str, parsed_at: Column | None = None, multiline: bool = True) -> DataFrame:
    """Extracted postings without the failed ones; ``company`` is the document's, else the file's stem."""
    exploded = _read(spark, path, EXTRACTED_FILE, multiline).select(
        path_ats().alias("ats"),
        F.coalesce(F.col("company"), path_company()).alias("company"),
        _path().alias("file"),
        F.posexplode("jobs").alias("pos", "job"),
    )
    no_terms = F.array().cast("array<string>")
    stamp = F.localtimestamp() if parsed_at is None else parsed_at
    return exploded.where("job.error IS NULL").select(
        _or_blank("job.job_id").alias("job_id"),
        "company", "ats",
        *[_or_blank(f"job.{n}").alias(n) for n in ("title", "url", "location")],
        *[F.col(f"job.{n}").alias(n) for n in EXTRACTED_SCALARS],
        *[F.coalesce(F.col(f"job.{n}"), no_terms).alias(n) for n in EXTRACTED_ARRAYS],
        stamp.cast("timestamp_ntz").alias("parsed_at"),
        "file", "pos",
    )


def scan_profiles(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Profile documents named ``{ats}_{company}.json``, or kept in a folder ``profile={ats}_{company}``;
    the name splits at the first underscore."""
    folder = F.regexp_extract(_path(), r"/profile=([^/]+)/", 1)
    name = F.split(F.when(folder != "", _decoded(folder)).otherwise(file_stem()), "_", 2)
    zero = F.lit(0)
    return (
        _read(spark, path, PROFILE_FILE, multiline)
        .withColumn("name", name)
        .where(F.size("name") == 2)
        .select(
            F.get("name", F.lit(1)).alias("company"),
            F.get("name", F.lit(0)).alias("ats"),
            F.coalesce("total_jobs", zero).alias("total_jobs"),
            F.coalesce("jobs_parsed", zero).alias("jobs_parsed"),
            F.coalesce("parse_rate", F.lit(0.0)).alias("parse_rate"),
            F.coalesce("departments", F.create_map().cast("map<string,bigint>")).alias("departments"),
            F.coalesce("seniority", F.create_map().cast("map<string,bigint>")).alias("seniority_breakdown"),
            F.coalesce("tech_stack", F.array().cast(PROFILE_FILE["tech_stack"].dataType)).alias("top_tech_stack"),
            F.coalesce("skills", F.array().cast(PROFILE_FILE["skills"].dataType)).alias("top_skills"),
            F.coalesce("pain_points", F.array().cast(PROFILE_FILE["pain_points"].dataType)).alias("top_pain_points"),
            F.coalesce("hiring_signals", F.array().cast("array<string>")).alias("hiring_signals"),
        )
    )


def decode_ignoring_errors(content: Column) -> Column:
    """UTF-8 text of binary content, bytes that are not UTF-8 left out."""
    raw = content.cast("string")
    # A replacement character that the text itself holds is set aside, so that only those put in
    # for broken bytes are dropped.
    kept = F.replace(raw, F.lit("\ufffd"), F.lit("\ufffe\uffff"))
    dropped = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    restored = F.replace(dropped, F.lit("\ufffe\uffff"), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def resume_gate(resumes: DataFrame, text: str = "text") -> DataFrame:
    """Resumes that hold text, cut to the length a prompt may carry."""
    return resumes.where(strip(F.col(text)) != "").withColumn(text, truncate(F.col(text), MAX_RESUME))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """Text resumes of a folder as ``path, text``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return resume_gate(files.select("path", decode_ignoring_errors(F.col("content")).alias("text")))


def save_postings(records: DataFrame, path: str, keys: tuple[str, ...] = ("ats", "slug"), companies: DataFrame | None = None) -> None:
    """Write one folder per company, replacing only the companies present in ``records``, and those in ``companies``.

    ``companies`` lists the keys of all companies that were scraped. One that lost all its postings is not in ``records``; it
    gets a row without values, which replaces its folder and which ``read_postings`` leaves out.
    The rebalance hint gathers a company into few files and still splits a hot company over tasks.
    """
    if companies is not None:
        emptied = companies.select(*keys).distinct().join(records.select(*keys).distinct(), list(keys), "left_anti")
        records = records.unionByName(emptied, allowMissingColumns=True)
    (
        records.hint("rebalance", *[F.col(k) for k in keys])
        .write.partitionBy(*keys)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_postings(spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...] = ("ats", "slug")) -> DataFrame:
    """What ``save_postings`` wrote, without the rows that stand for emptied companies."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns if c not in keys]).isNotNull())


def export_csv(rows: DataFrame, path: str) -> None:
    """Write a result as CSV files with a header each, for spreadsheets: lists as text between ``|``, other nested columns as JSON, line breaks and quotes inside
    quoted fields, empty text told apart from NULL. As many files as the plan has tasks, so no row passes through one task that need not."""
    texts = {}
    for field in rows.schema:
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            texts[field.name] = F.array_join(field.name, "|")
        elif isinstance(field.dataType, ArrayType | MapType | StructType | VariantType):
            texts[field.name] = F.to_json(field.name)
    flat = rows.withColumns(texts) if texts else rows
    flat.write.mode("errorifexists").options(
        header=True, escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What ``export_csv`` wrote. A text of one NUL character reads as NULL."""
    return spark.read.schema(schema).options(header=True, escape='"', emptyValue="", nullValue="\0", multiLine=True).csv(path)
