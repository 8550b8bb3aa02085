"""Turning postings into structured fields with a user-supplied model function."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import is_empty_object, reply_fields, salvage_json
from ..functions.terms import no_terms, normalize_skills, normalize_tech_stack
from ..functions.text import extraction_prompt, has_text, truncate
from ..schemas import (
    BAD_REPLY,
    BATCH_SIZE,
    EXTRACTED_ARRAYS,
    EXTRACTED_SCALARS,
    MAX_DESCRIPTION,
    MIN_DESCRIPTION,
    NO_DESCRIPTION,
)

# Takes the prompts of one call, returns one reply (or None) for each, in order.
Model = Callable[[list[str]], list[str | None]]


def gate_description(postings: DataFrame, column: str = "description") -> DataFrame:
    """Cut descriptions to the prompt's length; too short or missing ones get an error."""
    text = truncate(F.col(column), MAX_DESCRIPTION)
    usable = has_text(text) & (F.length(text) >= MIN_DESCRIPTION)
    return postings.withColumn(column, text).withColumn(
        "error", F.when(~usable, F.lit(NO_DESCRIPTION)).cast("string")
    )


def retrying(model: Model, max_tries: int = 5, sleep: Callable[[float], None] | None = None) -> Model:
    """Repeat rate-limited calls with growing waits; any other failure gives no reply for that prompt.

    An error counts as a rate limit if its class name or message says so. A wait asked for in the
    message ("retry after N") is honoured. If a call with many prompts fails otherwise, the prompts
    are tried one by one, so that one bad prompt does not take the others with it.
    """

    def call(prompts: list[str]) -> list[str | None]:
        import random
        import re
        import time

        for attempt in range(max_tries):
            try:
                return list(model(prompts))
            except Exception as error:
                message = f"{type(error).__name__} {error}".lower()
                if "ratelimit" not in message and "rate limit" not in message:
                    break
                if attempt == max_tries - 1:
                    return [None] * len(prompts)
                asked = re.search(r"retry after (\d+)", message)
                wait = 2**attempt + random.random()
                (sleep or time.sleep)(max(wait, float(asked[1])) if asked else wait)
        if len(prompts) == 1:
            return [None]
        return [reply for prompt in prompts for reply in call([prompt])]

    return call


def model_replies(prompt: Column, model: Model, call_size: int = BATCH_SIZE) -> Column:
    """The model's reply to each prompt; a NULL prompt is not sent.

    Only the prompt column crosses to Python, in Arrow batches. The column is marked as
    non-deterministic, so the optimizer neither repeats the call nor moves a filter across it.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            replies = pd.Series([None] * len(prompts), dtype=object)
            asked = [i for i, p in enumerate(prompts) if p is not None]
            for start in range(0, len(asked), call_size):
                chunk = asked[start : start + call_size]
                for i, reply in zip(chunk, model([prompts.iloc[i] for i in chunk]), strict=True):
                    replies.iloc[i] = reply
            yield replies

    return ask.asNondeterministic()(prompt)


def extract_jobs(
    postings: DataFrame, model: Model, call_size: int = BATCH_SIZE, parallelism: int | None = None
) -> DataFrame:
    """Extracted fields of each posting, or an error.

    ``postings`` has ``job_id, title, company, location, url, description``; further columns pass
    through. Scanned files are skewed by company: ``parallelism`` spreads the postings evenly over that
    many tasks first. Model calls are dear, so write the result to a table before using it twice.
    """
    spread = postings if parallelism is None else postings.repartition(parallelism)
    asked = prompted(spread)
    return extracted_fields(asked.withColumn("_reply", model_replies(F.col("_prompt"), retrying(model), call_size)), postings.columns)


def prompted(postings: DataFrame) -> DataFrame:
    """The postings with cut descriptions, an error where there is nothing to ask, and else the ``_prompt`` to send."""
    prompt = extraction_prompt(F.col("title"), F.col("company"), F.col("location"), F.col("description"))
    return gate_description(postings).withColumn("_prompt", F.when(F.col("error").isNull(), prompt))


def extracted_fields(replied: DataFrame, columns: list[str]) -> DataFrame:
    """The fields in the ``_reply`` of each row of ``prompted``, or an error; ``columns`` of the postings pass through."""
    replied = replied.withColumn("_json", salvage_json(F.col("_reply")))
    failed = F.col("_json").isNull() | is_empty_object(F.col("_json"))
    error = F.coalesce(F.col("error"), F.when(failed, F.lit(BAD_REPLY)))
    checked = replied.withColumn("error", error).withColumn(
        "_json", F.when(F.col("error").isNull(), F.col("_json"))
    )
    # Parsed once, in a column of its own. A list the reply leaves out stays NULL; one it gives is normalized,
    # also when empty.
    parsed = checked.withColumn("_value", F.try_parse_json("_json"))
    fields = reply_fields(F.col("_value"))
    for name, normalize in {"tech_stack": normalize_tech_stack, "skills": normalize_skills}.items():
        given = F.try_variant_get(F.col("_value"), f"$.{name}", "variant").isNotNull()
        fields[name] = F.when(given, normalize(fields[name]))
    names = [*EXTRACTED_SCALARS, *EXTRACTED_ARRAYS]
    passed = [c for c in columns if c not in (*names, "description")]
    return parsed.select(*passed, *[fields[n].alias(n) for n in names], "error")


def upsert_rows(extracted: DataFrame, parsed_at: Column) -> DataFrame:
    """The successful rows of ``extract_jobs``, ready for ``upsert_parsed``: absent lists empty, stamped."""
    rows = extracted.where("error IS NULL").drop("error")
    stamped = rows.withColumns({n: F.coalesce(n, no_terms()) for n in EXTRACTED_ARRAYS} | {"parsed_at": parsed_at})
    # Of two rows of a key with one stamp the same one must win every time: their content decides.
    return stamped.withColumns({"file": F.lit(""), "pos": F.xxhash64(*stamped.columns)})
