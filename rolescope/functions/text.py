"""Text columns: HTML cleaning, trimming, truncation, rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEPARTMENTS, REMOTE_POLICIES, SENIORITIES

# Fixed value: the characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# One left-to-right pass, so that a comment inside a script (or the reverse) is settled by whichever
# opens first. Possessive loops: no recursion. See ``_replace_markup`` for what keeps the time linear.
MARKUP = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b[^>]*+>.*?(?:</script\s*+>|\z)"
    r"|style\b[^>]*+>.*?(?:</style\s*+>|\z)"
    r"|noscript\b[^>]*+>.*?(?:</noscript\s*+>|\z)"
    r"|/?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|/?[a-z][^>]*+>"
    r"|[!?/][^>]*+>)"
)
TAG = r"<[^>]++>"
# A hidden "<". The sign itself, should a text hold it, is written with another digit meanwhile.
SIGN = "\ufffe"
HIDDEN, ESCAPED = f"{SIGN}1", f"{SIGN}0"
# The body of a fenced block; no body if the closing fence follows the first line at once.
FENCED = r"(?s)\A```[^\n]*(?:\n```|\n(.*?)(?:\n```)?)?\z"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def unescape_entities(col: Column) -> Column:
    """Decode HTML entities; only texts holding an ampersand travel to Python."""
    import html

    decode = html.unescape  # bound here so that the closure needs no package on the executors

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(decode, na_action="ignore")

    return F.coalesce(unescape(F.when(col.contains("&"), col)), col)


def _lines(col: Column) -> Column:
    trimmed = F.transform(F.split(col, "\n"), strip)
    return F.array_join(F.filter(trimmed, lambda line: line != ""), "\n")


def _after_last(col: Column, end: str) -> Column:
    """Place behind the last ``end``; 1 if there is none."""
    back = F.instr(F.reverse(col), end[::-1])
    return F.when(back > 0, F.length(col) - back + 2).otherwise(1)


def _replace_markup(col: Column, pattern: str, by: str) -> Column:
    """Replace markup. A "<" that no ">" follows and a "<!--" that no "-->" follows are text, so they are hidden from the
    pattern: every other one finds an end, and no attempt scans to the end of a long document in vain. What is left to rescan are
    tags whose quotes never close."""
    col = F.replace(col, F.lit(SIGN), F.lit(ESCAPED))
    tail, uncommented = _after_last(col, ">"), _after_last(col, "-->")
    parts = F.concat(
        F.substring(col, F.lit(1), uncommented - 1),
        F.replace(F.substring(col, uncommented, tail - uncommented), F.lit("<!--"), F.lit(f"{HIDDEN}!--")),
        F.replace(F.substring(col, tail, F.length(col)), F.lit("<"), F.lit(HIDDEN)),
    )
    return F.replace(F.replace(F.regexp_replace(parts, pattern, by), F.lit(HIDDEN), F.lit("<")), F.lit(ESCAPED), F.lit(SIGN))


def clean_html(col: Column) -> Column:
    """Visible text of an HTML document, one trimmed non-empty line per text node; NULL gives ''."""
    visible = unescape_entities(_replace_markup(col, MARKUP, "\n"))
    return F.coalesce(_lines(visible), F.lit(""))


def clean_description(col: Column) -> Column:
    """Clean a description that may be HTML or escaped HTML; plain text passes unchanged."""
    looks_like_html = col.contains("<") | col.contains("&lt;")
    cleaned = clean_html(unescape_entities(F.when(looks_like_html, col)))
    return F.when(looks_like_html, cleaned).otherwise(F.coalesce(col, F.lit("")))


def strip_tags(col: Column) -> Column:
    """Rough cleaning: each tag becomes a blank."""
    return strip(_replace_markup(col, TAG, " "))


def truncate(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)


def has_text(col: Column) -> Column:
    """Not NULL and not empty."""
    return F.coalesce(F.length(col) > 0, F.lit(False))


def strip_fence(col: Column) -> Column:
    """Drop the first line of a fenced block, and the last line if it is exactly the fence."""
    text = strip(col)
    return F.when(text.startswith("```"), F.regexp_extract(text, FENCED, 1)).otherwise(text)


def terminate_sql(col: Column) -> Column:
    """Trimmed statement with one trailing semicolon."""
    text = strip(col)
    return F.when(text.endswith(";"), text).otherwise(F.concat(text, F.lit(";")))


def _or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


PROMPT_HEAD = "Read the job posting below and fill in its fields.\nRole: "
PROMPT_TAIL = (
    "\n\nAnswer with one JSON object and nothing else. Keys:\n"
    f"department (one of {', '.join(DEPARTMENTS)}), seniority (one of {', '.join(SENIORITIES)}), "
    "tech_stack (list of named technologies only), skills (list of soft skills and domain knowledge), "
    "pain_points (list of problems the role is hired to solve), job_summary (one sentence on the main duty), "
    f"remote_policy (one of {', '.join(REMOTE_POLICIES)}), salary_min, salary_max and experience_years "
    "(whole numbers, null if not stated)."
)


def extraction_prompt(title: Column, company: Column, location: Column, description: Column) -> Column:
    """The instruction sent to the model for one posting."""
    return F.concat(
        F.lit(PROMPT_HEAD), _or_empty(title),
        F.lit("\nEmployer: "), _or_empty(company),
        F.lit("\nPlace: "), _or_empty(location),
        F.lit("\nText:\n"), _or_empty(description),
        F.lit(PROMPT_TAIL),
    )


def posting_block(job: dict[str, Column]) -> Column:
    """One posting as a text block; a NULL array renders as nothing, a NULL scalar as 'None'."""

    def shown(name: str) -> Column:
        return F.coalesce(job[name].cast("string"), F.lit("None"))

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(job[name], ", "), F.lit(""))

    return F.concat(
        F.lit("\n---\nPosting "), shown("id"), F.lit(": "), shown("title"), F.lit(", "), shown("company"),
        F.lit("\nPlace: "), shown("location"), F.lit("; remote: "), shown("remote_policy"),
        F.lit("\nDepartment: "), shown("department"), F.lit("; level: "), shown("seniority"),
        F.lit("; years: "), shown("experience_years"),
        F.lit("\nTechnologies: "), listed("tech_stack"),
        F.lit("\nSkills: "), listed("skills"),
        F.lit("\nSummary: "), shown("job_summary"), F.lit("\n"),
    )


# The shortest block posting_block can render: its fixed text plus nothing in any field. A prompt cut at
# n characters can hold the start of at most n / MIN_BLOCK + 1 blocks.
MIN_BLOCK = len("\n---\nPosting : , \nPlace: ; remote: \nDepartment: ; level: ; years: \nTechnologies: \nSkills: \nSummary: \n")
