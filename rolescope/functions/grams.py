"""Three-character grams, for finding substrings without scanning texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 3
WILDCARD = r"[%_\\]"


def grams(text: Column) -> Column:
    """The distinct grams of a lower-cased text, as many as it has places; none for NULL and for texts of under three characters.

    A lookahead steps on by one character, so that cutting takes time in proportion to the text.
    """
    cut = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1))
    return F.coalesce(F.array_distinct(cut), F.array().cast("array<string>"))


def text_grams(columns: tuple[str, ...] | list[str]) -> Column:
    """The distinct grams of several columns; none spans two of them."""
    return F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))


def needle_grams(needle: Column) -> Column:
    """Grams that any text holds which ``contains_text`` finds the needle in: those of its pieces between wildcards."""
    return F.array_distinct(F.flatten(F.transform(F.split(needle, WILDCARD), grams)))


def is_plain(needle: Column) -> Column:
    """Whether a needle holds no wildcard and no escape."""
    return ~F.regexp_like(needle, F.lit(WILDCARD))
