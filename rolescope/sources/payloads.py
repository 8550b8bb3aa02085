"""Raw posting payloads of the four applicant-tracking systems, mapped to one record.

Input rows are ``ats, slug, raw`` with one JSON payload per row. Each payload is parsed once, and each
field is read on its own, so one odd value never loses a posting. Parsing and mapping stay in the
scan's own task: no shuffle, and a company with many payload rows is spread like any other rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import is_one_value, wrapped_json
from ..functions.text import clean_description, clean_html
from ..schemas import BAD_PAYLOAD, UNKNOWN_ATS

RECORD = ["ats", "slug", "id", "title", "location", "url", "description"]


def _text(path: str) -> Callable[[Column, Column], Column]:
    return lambda _slug, posting: F.coalesce(F.try_variant_get(posting, path, "string"), F.lit(""))


def _is_absent(posting: Column, path: str) -> Column:
    return F.try_variant_get(posting, path, "variant").isNull()


def _built_url(prefix: str, suffix: str) -> Callable[[Column, Column], Column]:
    return lambda slug, posting: F.concat(
        F.lit(prefix), slug, F.lit(suffix), F.coalesce(F.try_variant_get(posting, "$.id", "string"), F.lit(""))
    )


def _url_or_built(path: str, prefix: str, suffix: str) -> Callable[[Column, Column], Column]:
    built = _built_url(prefix, suffix)
    return lambda slug, posting: F.coalesce(F.try_variant_get(posting, path, "string"), built(slug, posting))


@dataclass(frozen=True)
class Feed:
    """Where one system keeps the list of postings and each field of a posting."""

    postings: str
    title: Callable[[Column, Column], Column]
    location: Callable[[Column, Column], Column]
    url: Callable[[Column, Column], Column]
    description: Callable[[Column, Column], Column] | None


# Payload paths and public posting addresses.
FEEDS: dict[str, Feed] = {
    "greenhouse": Feed(
        "$.jobs", _text("$.title"), _text("$.location.name"),
        _built_url("https://boards.greenhouse.io/", "/jobs/"), _text("$.content"),
    ),
    "lever": Feed(
        "$", _text("$.text"), _text("$.categories.location"), _text("$.hostedUrl"), _text("$.descriptionPlain"),
    ),
    "ashby": Feed(
        "$.jobs", _text("$.title"), _text("$.location"),
        _url_or_built("$.jobUrl", "https://jobs.ashbyhq.com/", "/"), _text("$.descriptionPlain"),
    ),
    "smartrecruiters": Feed(
        "$.content", _text("$.name"), _text("$.location.city"),
        _built_url("https://jobs.smartrecruiters.com/", "/"), None,
    ),
}
# Section order of a SmartRecruiters posting.
SECTIONS = ["jobDescription", "qualifications", "additionalInformation", "companyDescription"]


def _by_ats(fields: dict[str, Column]) -> Column:
    """The expression of a row's own system."""
    (first, column), *others = fields.items()
    chosen = F.when(F.col("ats") == first, column)
    for ats, column in others:
        chosen = chosen.when(F.col("ats") == ats, column)
    return chosen


def parse_feeds(payloads: DataFrame, systems: tuple[str, ...] = tuple(FEEDS)) -> DataFrame:
    """Postings of some systems, in one scan and one parse of each payload; a payload that does not parse, or has no list, gives no rows.
    Descriptions are cleaned; a system that has none in its list gets ''."""
    feeds = {ats: FEEDS[ats] for ats in systems}
    slug, posting = F.col("slug"), F.col("posting")
    # Parsed in a column of its own and checked inside the generator: a filter would be moved below the
    # parsing and parse each payload again.
    parsed = payloads.where(F.col("ats").isin(*systems)).withColumn("_json", wrapped_json(F.col("raw")))
    listed = _by_ats({ats: F.try_variant_get("_json", "$[0]" + f.postings.removeprefix("$"), "array<variant>") for ats, f in feeds.items()})
    exploded = parsed.select("ats", "slug", F.explode(F.when(is_one_value(F.col("_json")), listed)).alias("posting"))
    mapped = exploded.select(
        "ats", "slug",
        _text("$.id")(slug, posting).alias("id"),
        _by_ats({ats: f.title(slug, posting) for ats, f in feeds.items()}).alias("title"),
        _by_ats({ats: f.location(slug, posting) for ats, f in feeds.items()}).alias("location"),
        _by_ats({ats: f.url(slug, posting) for ats, f in feeds.items()}).alias("url"),
        _by_ats({ats: F.lit("") if f.description is None else f.description(slug, posting) for ats, f in feeds.items()}).alias("description"),
    )
    if all(f.description is None for f in feeds.values()):
        return mapped
    return mapped.withColumn("description", clean_description(F.col("description")))


def parse_feed(payloads: DataFrame, ats: str) -> DataFrame:
    """Postings of one system."""
    return parse_feeds(payloads, (ats,))


def section_text(detail: Column) -> Column:
    """The description in a posting's parsed detail document: titled sections in fixed order."""
    parts = []
    for name in SECTIONS:
        title = F.try_variant_get(detail, f"$[0].jobAd.sections.{name}.title", "string")
        text = F.try_variant_get(detail, f"$[0].jobAd.sections.{name}.text", "string")
        heading = F.when(title != "", F.concat(F.lit("## "), title))
        parts.append(F.when(text != "", F.concat_ws("\n\n", heading, clean_html(text))))
    return F.concat_ws("\n\n", *parts)


def with_sections(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Give each posting the description of its detail document (``slug, id, raw``), '' if there is none.

    Of several details of a posting the greatest text counts, so the join adds no rows. Cleaning runs before
    both shuffles: what is sent is text, not markup.
    """
    parsed = details.withColumn("_json", wrapped_json(F.col("raw")))
    valid = parsed.withColumn("_json", F.when(is_one_value(F.col("_json")), F.col("_json")))
    texts = valid.select("slug", "id", section_text(F.col("_json")).alias("section_text"))
    cleaned = texts.groupBy("id", "slug").agg(F.max("section_text").alias("section_text"))
    return (
        postings.drop("description")
        .join(cleaned, ["id", "slug"], "left")
        .withColumn("description", F.coalesce("section_text", F.lit("")))
        .select(*RECORD)
    )


def parse_payloads(payloads: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """All systems as one table of records, in one scan; with ``details`` the system that has them is read on its own, so that no
    other system's postings are sent to the join."""
    if details is None:
        return parse_feeds(payloads)
    detailed = "smartrecruiters"
    others = parse_feeds(payloads, tuple(ats for ats in FEEDS if ats != detailed))
    return others.select(*RECORD).unionByName(with_sections(parse_feed(payloads, detailed), details))


def payload_error() -> Column:
    """Why a payload is kept out: an unknown system, or text that is not JSON or a mere ``null``; else NULL."""
    known = F.coalesce(F.col("ats").isin(*FEEDS), F.lit(False))
    unknown = F.concat(F.lit(UNKNOWN_ATS), F.coalesce("ats", F.lit("")))
    return F.when(~known, unknown).when(~_is_payload(F.col("raw")), F.lit(BAD_PAYLOAD))


def _is_payload(raw: Column) -> Column:
    return is_one_value(wrapped_json(raw)) & (F.btrim(raw, F.lit(" \t\r\n")) != "null")


def payload_errors(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("error", payload_error()).where("error IS NOT NULL").drop("raw")


def scrape_counts(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """Per company: postings, and postings with a description. A company without postings counts 0;
    one with a failed payload is left out.

    Both sides are reduced to one row per company before they meet.
    """
    companies = payloads.groupBy("ats", "slug").agg(F.count(payload_error()).alias("failed")).where("failed = 0")
    counts = records.groupBy("ats", "slug").agg(
        F.count("*").alias("jobs_count"),
        F.count_if(F.length("description") > 0).alias("jobs_with_description"),
    )
    counted = companies.drop("failed").join(counts, ["ats", "slug"], "left")
    return counted.na.fill(0, ["jobs_count", "jobs_with_description"])
