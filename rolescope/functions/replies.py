"""Reading JSON out of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTRACTED_ARRAYS, EXTRACTED_SCALARS, MATCH_FIELDS
from .text import strip, strip_fence

# Fixed value: braces count as an object with one nested level at most. Possessive, so the scan stays linear on long replies.
BRACES = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
FENCE = "```"
NUMBERS = ("bigint", "double")


def wrapped_json(text: Column) -> Column:
    """The text parsed as the first item of a list that ends in 0.

    The parser stops after one value and lets any text follow. Wrapped, the 0 is in second place only if
    the text is exactly one JSON value: one parse both checks and reads it, under the path ``$[0]``.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))


def is_one_value(wrapped: Column) -> Column:
    return F.coalesce(F.try_variant_get(wrapped, "$[1]", "int") == 0, F.lit(False))


def _is_object(text: Column) -> Column:
    return text.startswith("{") & text.endswith("}") & is_one_value(wrapped_json(text))


def salvage_json(reply: Column) -> Column:
    """The first JSON object found in a reply, as text: the whole reply, else braces, else a fenced block."""
    whole = strip(reply)
    parts = F.split(reply, FENCE)
    inside = F.slice(parts, 2, F.greatest(F.array_size(parts) - 2, F.lit(0)))  # between two fences
    labelled = F.filter(inside, lambda part: part.startswith("json"))
    candidates = F.concat(
        F.regexp_extract_all(reply, F.lit(BRACES), F.lit(0)),
        F.transform(labelled, lambda part: strip(F.substring(part, F.lit(5), F.length(part)))),
        F.transform(F.filter(inside, lambda _, i: i % 2 == 0), strip),
    )
    return F.when(_is_object(whole), whole).otherwise(F.get(F.filter(candidates, _is_object), F.lit(0)))


def reply_fields(value: Column) -> dict[str, Column]:
    """The extracted fields of a parsed reply; a value of the wrong type becomes NULL on its own."""
    fields = {n: F.try_variant_get(value, f"$.{n}", t) for n, t in EXTRACTED_SCALARS.items()}
    fields |= {n: F.try_variant_get(value, f"$.{n}", "array<string>") for n in EXTRACTED_ARRAYS}
    return fields


def is_empty_object(json_text: Column) -> Column:
    return F.json_object_keys(json_text) == F.array().cast("array<string>")


def parse_matches(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The matches in model replies, one row each, beside the other columns; see ``match_errors`` for the rest."""
    others = [c for c in replies.columns if c != reply]
    # The list is not a column of its own: Spark would filter on it, and so parse each reply again.
    unfenced = replies.withColumn("_text", strip_fence(F.col(reply)))
    listed = unfenced.select(*others, F.explode(_match_list(F.col("_text"))).alias("_item"))
    # Numbers are read as text, so that 87.5 or "87" still counts.
    fields = {
        name: F.col(f"_item.{name}").try_cast("double").cast(kind) if kind in NUMBERS else F.col(f"_item.{name}")
        for name, kind in MATCH_FIELDS.items()
    }
    return listed.where("_item IS NOT NULL").select(*others, *[c.alias(n) for n, c in fields.items()])


def match_errors(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies that are not a JSON list."""
    return replies.where(_match_list(strip_fence(F.col(reply))).isNull())


def _match_list(text: Column) -> Column:
    schema = ", ".join(f"{name}: {'string' if kind in NUMBERS else kind}" for name, kind in MATCH_FIELDS.items())
    is_list = text.startswith("[") & text.endswith("]") & is_one_value(wrapped_json(text))
    return F.when(is_list, F.from_json(text, f"array<struct<{schema}>>"))
