"""Normalizing and finding terms with a dictionary that is a table, of any size: rows ``variant, canonical``.

Nothing of a dictionary enters the plan or the driver: lists and texts are cut into spellings, and these are joined with it.
Spark broadcasts the smaller side by its size; beyond that both are shuffled, and AQE splits a spelling that many rows hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import no_terms
from ..functions.text import strip
from ..session import stored
from .rules import description_words


def cleaned(term: Column) -> Column:
    """A spelling as it is looked up: in lower case, trimmed, never NULL."""
    return F.coalesce(strip(F.lower(term)), F.lit(""))


def spellings(dictionary: DataFrame) -> DataFrame:
    """``variant, canonical`` with each cleaned variant once; of several names the first in order counts. Rows without a variant are left out."""
    rows = dictionary.select(cleaned(F.col("variant")).alias("variant"), "canonical").where("variant <> '' AND canonical IS NOT NULL")
    return rows.groupBy("variant").agg(F.min("canonical").alias("canonical"))


def normalize_lists(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """``rows`` with the terms of a list column replaced by their distinct canonical names in order; unknown spellings stay, cleaned. NULL gives an empty list.

    Each distinct list is normalized once; the results, stored, are joined back by the list itself.
    """
    lists = stored(rows.select(F.col(column).alias("_list")).where(F.size("_list") > 0).distinct(), "lists")
    terms = lists.select("_list", F.explode(F.array_distinct(F.transform("_list", cleaned))).alias("variant"))
    named = terms.join(spellings(dictionary), "variant", "left").select("_list", F.coalesce("canonical", "variant").alias("_name"))
    merged = named.where("_name <> ''").groupBy("_list").agg(F.array_sort(F.collect_set("_name")).alias("_names"))
    known = stored(merged, "normalized-lists")
    joined = rows.join(known, rows[column].eqNullSafe(known["_list"]), "left")
    return joined.select(*[F.coalesce(known["_names"], no_terms()).alias(c) if c == column else rows[c] for c in rows.columns])


def find_terms(postings: DataFrame, keys: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """``keys`` and ``terms``, the distinct canonical names, in order, of the dictionary spellings met in a text; one row per posting, whose keys are unique.

    Of a text, only those runs of words go on that begin with a word some spelling begins with and are as long as a spelling
    with that first word: the work follows the text, not the dictionary.
    """
    listed = stored(spellings(dictionary).withColumn("_size", F.size(F.split("variant", " "))).withColumn("_first", F.element_at(F.split("variant", " "), 1)), "spellings")
    firsts = stored(listed.groupBy("_first").agg(F.collect_set("_size").alias("_sizes")), "first-words")
    words = stored(postings.select(*keys, description_words(F.col(text)).alias("_words")), "words")
    heads = words.select(*keys, F.posexplode("_words").alias("_at", "_first")).join(firsts, "_first").select(*keys, "_at", F.explode("_sizes").alias("_size"))
    runs = heads.groupBy(*keys).agg(F.collect_list(F.struct("_at", "_size")).alias("_runs")).join(words, keys)
    # A run beyond the end of the text is shorter than asked and meets no spelling of its length.
    cut = F.transform("_runs", lambda r: F.array_join(F.slice("_words", r["_at"] + 1, r["_size"]), " "))
    met = runs.select(*keys, F.explode(F.array_distinct(cut)).alias("variant")).join(listed.select("variant", "canonical"), "variant")
    found = met.groupBy(*keys).agg(F.array_sort(F.collect_set("canonical")).alias("terms"))
    return postings.select(*keys).join(found, keys, "left").withColumn("terms", F.coalesce("terms", no_terms()))

