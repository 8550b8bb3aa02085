"""Incremental scans of a tree of scraped documents: only what changed since the last scan is parsed.

A manifest lists each file with size, time of change and a hash of its content. A refresh lists the tree, which opens no file; files whose size or time
differ are read and hashed; of those, only files with other content count as changed. Companies with a changed, new or removed file are
parsed again, with all their files, and replace their folders in the output; the others stay as they are. The manifest
follows when the output stands, so a refresh that is stopped is simply run again.

Spark packs small files into tasks by size (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``). The driver holds no more paths than
Spark's own listing: they are fetched in groups, and each group is one read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import SCRAPED_FILE
from ..session import new_work_dir, stored
from .files import path_ats, path_company, postings_of, read_postings, save_postings, scan_scraped

_FILES = "path string, time timestamp, size long, ats string, company string, hash string"
KEYS = ["ats", "company"]


@dataclass(frozen=True)
class Refreshed:
    """What a refresh has found: files that were hashed, files with new content, files that are gone, and companies that were replaced."""

    opened: int
    changed: int
    removed: int
    companies: int


def _listing(spark: SparkSession, tree: str) -> DataFrame:
    """The files of a tree; their content is not read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.json").load(tree)
    return files.select("path", F.col("modificationTime").alias("time"), F.col("length").alias("size"), path_ats().alias("ats"), path_company().alias("company"))


def _groups(paths: DataFrame, size: int) -> Iterator[list[str]]:
    """The paths of a stored table, in groups, with glob characters escaped."""
    group: list[str] = []
    for row in paths.select("path").toLocalIterator():
        group.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", row.path))
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group


def _gathered(spark: SparkSession, paths: DataFrame, read: Callable[[list[str]], DataFrame], per_read: int, label: str) -> DataFrame | None:
    """What ``read`` makes of the paths, group by group, as one work table."""
    work, schema = new_work_dir(spark, label), None
    for group in _groups(paths, per_read):
        rows = read(group)
        rows.write.mode("append").parquet(work)
        schema = rows.schema
    return None if schema is None else spark.read.schema(schema).parquet(work)


def _newest(spark: SparkSession, manifest: str) -> tuple[int, DataFrame]:
    """Number and rows of the last manifest; -1 and no rows before the first."""
    try:
        version = spark.read.parquet(manifest).agg(F.max("version").alias("v")).first().v
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        version = None
    if version is None:
        return -1, spark.createDataFrame([], _FILES)
    return int(version), spark.read.schema(_FILES).parquet(f"{manifest}/version={version}")


def refresh(spark: SparkSession, tree: str, manifest: str, out: str, multiline: bool = True, per_read: int = 10_000) -> Refreshed:
    """Bring the postings at ``out``, in folders by system and company, up to the tree. Read them by ``read_refreshed``.

    Postings that appear in several files of a company stay several rows, as in ``scan_scraped``; ``file`` and ``pos`` tell them apart.
    """
    manifest = manifest.rstrip("/")
    version, before = _newest(spark, manifest)
    listed = stored(_listing(spark, tree), "listing")
    fresh = stored(listed.join(before.select("path", "time", "size"), ["path", "time", "size"], "left_anti"), "fresh")
    removed = stored(before.join(listed, "path", "left_anti").select("path", *KEYS), "removed")

    def hashes(group: list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(group).select("path", F.sha2("content", 256).alias("hash"))

    hashed = _gathered(spark, fresh, hashes, per_read, "hashes")
    if hashed is None:
        hashed = spark.createDataFrame([], "path string, hash string")
    same = before.select("path", F.col("hash"))
    changed = stored(fresh.join(hashed.join(same, ["path", "hash"], "left_anti"), "path").select("path", *KEYS), "changed")
    companies = stored(changed.select(*KEYS).unionByName(removed.select(*KEYS)).distinct(), "companies")
    counts = Refreshed(fresh.count(), changed.count(), removed.count(), companies.count())
    if counts.companies:
        own = stored(listed.join(companies, KEYS, "left_semi").select("path"), "own")
        records = _gathered(spark, own, lambda group: scan_scraped(spark, group, multiline), per_read, "postings")
        if records is None:  # all files of these companies are gone
            records = spark.createDataFrame([], refreshed_schema(spark))
        save_postings(records, out, tuple(KEYS), companies)
    if counts.opened or counts.removed:
        kept = listed.join(before.select("path", "time", "size", "hash"), ["path", "time", "size"])
        known = kept.unionByName(fresh.join(hashed, "path"))
        known.select("path", "time", "size", *KEYS, "hash").write.mode("overwrite").parquet(f"{manifest}/version={version + 1}")
    return counts


def refreshed_schema(spark: SparkSession) -> StructType:
    """The columns that ``refresh`` writes."""
    documents = spark.createDataFrame([], SCRAPED_FILE).select("scraped_at", "jobs", *[F.lit("").alias(c) for c in (*KEYS, "file")])
    return postings_of(documents).schema


def read_refreshed(spark: SparkSession, out: str) -> DataFrame:
    """The postings that ``refresh`` keeps at ``out``."""
    return read_postings(spark, out, refreshed_schema(spark), tuple(KEYS))
