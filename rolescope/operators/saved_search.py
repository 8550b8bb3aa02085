"""Many saved searches against all postings at once: the needles are indexed, not the postings.

Each distinct needle is filed under its rarest gram. Postings explode the grams that any needle holds, join the needles filed there, and
only these pairs are verified. Work grows with the postings' text and the pairs that share a rare gram, not with needles times postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import is_plain, needle_grams, text_grams
from ..functions.predicates import contains_text
from ..session import stored

BLOCK = 200


def _holds(columns: tuple[str, ...]) -> Column:
    """Whether any of the columns contains the needle of the same row, as ``contains_text`` has it."""
    lowered = F.lower("needle")
    found = [F.when(F.col("_plain"), F.contains(F.lower(c), lowered)).otherwise(F.ilike(c, F.concat(F.lit("%"), "needle", F.lit("%")))) for c in columns]
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in found])


def needle_hits(rows: DataFrame, needles: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``id, needle`` for each row of ``rows`` (id, unique, and the columns) and each needle (column ``needle``, distinct, not NULL) that one of its columns contains.

    Needles without any gram, as they are too short between their wildcards, go through ``scan_hits``. ``rows`` is read more than once:
    pass a stored table. Texts are cut twice, to count the grams of needles and to find those that needles are filed under, so that no list of all grams is stored.
    """
    asked = stored(needles.select("needle", is_plain(F.col("needle")).alias("_plain"), needle_grams(F.col("needle")).alias("grams")), "needles")
    tokens = asked.select("needle", "_plain", F.explode("grams").alias("gram"))
    cut = rows.select("id", F.explode(text_grams(columns)).alias("gram"))
    counts = cut.join(tokens.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A needle with a gram that no posting holds finds nothing.
    rated = tokens.join(counts, "gram", "left").groupBy("needle", "_plain").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent"))
    filed = stored(rated.where("absent = 0").select("needle", "_plain", "gram"), "filed-needles")
    pairs = cut.join(filed, "gram").select("id", "needle", "_plain")
    found = pairs.join(rows.select("id", *columns), "id").where(_holds(columns)).select("id", "needle")
    return reduce(DataFrame.unionByName, [found, *scan_hits(rows, asked.where(F.size("grams") == 0).select("needle"), columns)])


def _value_hits(rows: DataFrame, needles: DataFrame, column: str) -> DataFrame:
    """``needle_hits`` in a single column, such as the company: each distinct value is searched once, whatever the number of its rows."""
    values = stored(rows.select(F.col(column).alias("id"), column).where(F.col(column).isNotNull()).distinct(), "values")
    found = needle_hits(values, needles, (column,)).select(F.col("id").alias(column), "needle")
    return rows.select("id", column).join(found, column).select("id", "needle")


def scan_hits(rows: DataFrame, needles: DataFrame, columns: tuple[str, ...]) -> Iterator[DataFrame]:
    """``id, needle`` as in ``needle_hits``, by scans: needles are read in blocks, and all of a block are tried in one scan, whose result is stored."""
    listed = needles.toLocalIterator()
    while block := [r.needle for r in islice(listed, BLOCK)]:
        tried = [F.when(reduce(lambda a, b: a | b, [F.coalesce(contains_text(F.col(c), n), F.lit(False)) for c in columns]), F.lit(n)) for n in block]
        yield stored(rows.select("id", F.explode(F.array_compact(F.array(*tried))).alias("needle")), "scanned-needles")


def passed(rows: DataFrame, searches: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each row of ``rows`` once per distinct search of ``searches`` that it passes, with the search's columns.

    ``fields`` tells for each column of ``searches``, not NULL, in which columns of ``rows`` its text must be; '' is no condition. The
    needles of each field are looked for on their own; a posting's hits in all fields are then matched with the searches there are.
    """
    tagged = rows
    for name, columns in fields.items():
        needles = searches.where(F.col(name) != "").select(F.col(name).alias("needle")).distinct()
        hits = needle_hits(rows, needles, columns) if len(columns) > 1 else _value_hits(rows, needles, *columns)
        every = rows.select("id", F.lit("").alias("needle"))
        tagged = tagged.join(hits.unionByName(every).withColumnRenamed("needle", name), "id")
    return tagged.join(stored(searches.select(*fields).distinct(), "searches"), list(fields))


def matched(jobs: DataFrame, searches: DataFrame, columns: tuple[str, ...] = ("title", "raw_description")) -> DataFrame:
    """``search_id, id`` of all postings that pass each saved search, say among the new ones of a day.

    A search has the columns search_id, query, company, department, seniority and remote_policy; '' or NULL is no condition. Both kinds of
    text are found as by ``contains_text``. Equal searches are looked for once.
    """
    exact = ("department", "seniority", "remote_policy")
    asked = searches.select("search_id", *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("query", "company", *exact)])
    rows = stored(jobs.select("id", *dict.fromkeys([*columns, "company", *exact])), "searched")
    tagged = passed(rows, asked, {"_query": tuple(columns), "_company": ("company",)}).select("id", "_query", "_company", *exact)
    pairs = tagged.join(asked, ["_query", "_company"])
    return pairs.where(reduce(lambda a, b: a & b, [(F.col(f"_{c}") == "") | (F.col(f"_{c}") == F.col(c)) for c in exact])).select("search_id", "id")
