"""Keyed upserts as joins. The result is a new table; callers write it to a new path."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTRACTED_ARRAYS, EXTRACTED_SCALARS, KEY, PROFILE_KEY
from ..session import stored
from .ranking import number_new

# What a conflict replaces; everything else of a stored row survives.
SCRAPED_COLUMNS = ["title", "url", "location", "raw_description"]
PARSED_COLUMNS = ["title", "url", "location", *EXTRACTED_SCALARS, *EXTRACTED_ARRAYS, "parsed_at"]


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by ``order``; columns in ``first`` come from the first row instead.

    An aggregate, not a window: each map task already reduces its rows to one per key, so a key that
    holds a third of the table arrives at its reducer as one row per map task.
    """
    rank = F.struct(*order)
    payload = [c for c in df.columns if c not in [*keys, *first, *order]]
    # The order columns come first in what is kept, so that they are sent once; of the first row, no more is kept than its columns need.
    kept = F.max(F.struct(*order, *payload)).alias("_last")
    firsts = [F.min(F.struct(c))[c].alias(c) if c == order[0] else F.min_by(c, rank).alias(c) for c in first]
    best = df.groupBy(*keys).agg(kept, *firsts)
    picked = {c: F.col(f"_last.{c}") for c in df.columns if c not in [*keys, *first]} | {c: F.col(c) for c in first}
    return best.select(*[picked.get(c, F.col(c)).alias(c) for c in df.columns])


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], replaced: list[str], inserted: tuple[str, ...] = ()
) -> DataFrame:
    """``target`` with ``source`` merged in: on a known key the ``replaced`` columns are taken from the
    source, NULL included; a new key brings these and its ``inserted`` columns, the rest is NULL.

    Both sides hold each key once, so the full join is one-to-one and no key can be hot.
    """
    t, s = target.alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.withColumn("_old", F.lit(True)).alias("t").join(s, same, "full_outer")
    in_source, in_target = F.col("s._new").isNotNull(), F.col("t._old").isNotNull()

    def merged(name: str) -> Column:
        if name in keys:
            return F.coalesce(F.col(f"t.{name}"), F.col(f"s.{name}"))
        if name in replaced:
            return F.when(in_source, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}"))
        if name in inserted:
            return F.when(in_target, F.col(f"t.{name}")).otherwise(F.col(f"s.{name}"))
        return F.col(f"t.{name}")

    return joined.select(*[merged(c).alias(c) for c in target.columns])


def dedupe_postings(postings: DataFrame) -> DataFrame:
    """Last write wins among equal keys of one load; the first write's time stamp stays."""
    return latest_by_key(postings, KEY, ["scraped_at", "file", "pos"], first=("scraped_at",))


def dedupe_at_rest(postings: DataFrame) -> DataFrame:
    """``dedupe_postings`` for rows that only read files, and can be read again: keys are counted first, without their texts, and only rows of
    keys that come more than once are sent. If these are over a tenth of the rows, all are. Counts at once; the rest is lazy."""
    counts = stored(postings.groupBy(*KEY).agg(F.count("*").alias("n")), "counts")
    n_rows, n_repeated = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).first()
    if not n_repeated:
        return postings
    if n_repeated * 10 > n_rows:
        return dedupe_postings(postings)
    repeated = stored(counts.where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in KEY]), "repeated")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    return postings.join(repeated, same, "left_anti").unionByName(dedupe_postings(postings.join(repeated, same, "left_semi")))


def needs_extraction(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """The scraped postings whose text has no extraction yet: new ones, changed ones, and those that were never parsed.

    An anti-join on key and hash of the description; the stored texts themselves are not sent.
    """
    known = jobs.where("parsed_at IS NOT NULL").select(*KEY, _text_hash())
    found = dedupe_postings(postings).withColumn("_hash", _text_hash())
    return found.join(known, [*KEY, "_hash"], "left_anti").drop("_hash").select(*postings.columns)


def _text_hash() -> Column:
    return F.sha2(F.coalesce("raw_description", F.lit("")), 256).alias("_hash")


def latest_extractions(extracted: DataFrame) -> DataFrame:
    """The last extraction of each key; a posting that was never scraped counts from its extraction on."""
    return latest_by_key(extracted, KEY, ["parsed_at", "file", "pos"]).withColumn("scraped_at", F.col("parsed_at"))


def upsert_numbered(target: DataFrame, source: DataFrame, replaced: list[str], inserted: tuple[str, ...], asked: DataFrame | None = None) -> DataFrame:
    """``upsert`` of one row per key, with ids for new keys, numbered on from the highest. Only the new keys are sorted and written; the target is
    read, never written. Stores the source and numbers at once; the merge itself is lazy.

    ``asked`` are the keys of a source that only reads files, got without its texts: then the source is not stored, and goes from the shuffle that
    made its rows straight into the merge."""
    if asked is None:
        source = asked = stored(source, "incoming")
    highest = target.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return upsert(target, number_new(source, target, KEY, highest, asked), KEY, replaced, (*inserted, "id"))


def upsert_scraped(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Merge scraped postings: a known posting keeps its id, its extracted fields and its first ``scraped_at``; new ones get
    ids, numbered on from the highest. See ``upsert_numbered``; ``keyed_table`` merges without reading the whole target."""
    return upsert_numbered(jobs, dedupe_postings(postings), SCRAPED_COLUMNS, ("scraped_at",))


def upsert_parsed(jobs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Merge extracted postings: a known posting keeps its id and ``raw_description``; NULL replaces too; new ones get ids.
    See ``upsert_numbered``."""
    return upsert_numbered(jobs, latest_extractions(extracted), PARSED_COLUMNS, ("scraped_at",))


def upsert_profiles(profiles: DataFrame, source: DataFrame) -> DataFrame:
    """Merge company profiles; all columns are replaced, ``analyzed_at`` included."""
    replaced = [c for c in profiles.columns if c not in PROFILE_KEY and c != "id"]
    return upsert(profiles, source, PROFILE_KEY, replaced)
