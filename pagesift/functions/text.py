"""Texts: queries, snippets, dates and tokens."""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions.batches import parts


def some(column: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(column, F.lit(""))


def clean(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))


def caseless(text: Column) -> Column:
    """The text in a form that is equal for texts that differ in case alone, in any script (`STRASSE`, `straße`); dotless i stays apart from i."""
    return F.upper(F.translate(F.lower(text), "\u0131", "\ue000"))


def with_year(query: Column, year: int) -> Column:
    """The query, with the year at its end if it holds no year of 1900 to 2099."""
    return F.when(query.rlike(r"\b(19|20)[0-9]{2}\b"), query).otherwise(F.concat(query, F.lit(f" {year}")))


def language(query: Column) -> Column:
    """`tr` for Turkish letters, for two Turkish words, or for one among at most five words; else `en`."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    known = F.size(F.array_intersect(words, F.array(*map(F.lit, K.TURKISH_WORDS))))
    turkish = query.rlike(f"[{K.TURKISH_LETTERS}]") | (known >= 2) | ((known >= 1) & (F.size(words) <= 5))
    return F.when(turkish, "tr").otherwise("en")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def profile(query: Column) -> Column:
    lower = F.lower(query)
    return F.when(_any(lower, K.ACADEMIC_WORDS), "academic").when(_any(lower, K.NEWS_WORDS), "news").otherwise("technical")


def tokens(text: Column) -> Column:
    """Distinct lexical tokens of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9._+-]+"), F.lit(0)))


def snippet(text: Column, size: int = 280) -> Column:
    flat = clean(text)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("...")))


def snippet_date(text: Column) -> Column:
    """An ISO date, else the year of a written date, else a bare year."""
    return F.coalesce(
        some(F.regexp_extract(text, K.SNIPPET_ISO_DATE, 1)),
        some(F.regexp_extract(text, K.SNIPPET_WRITTEN_DATE, 2)),
        some(F.regexp_extract(text, K.SNIPPET_YEAR, 1)),
    )


def content_date(text: Column) -> Column:
    """A date in JSON metadata, else an ISO date, else the year of a written date, in the first 4000 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    return F.coalesce(
        some(F.regexp_extract(head, K.CONTENT_METADATA_DATE, 1)),
        some(F.regexp_extract(head, K.CONTENT_ISO_DATE, 1)),
        some(F.regexp_extract(head, K.CONTENT_WRITTEN_DATE, 1)),
    )


def freshness(date: Column, text: Column, as_of_year: int) -> Column:
    """By age in years of the date, or of the first year in the text: 0.20, 0.10, 0, -0.10 or -0.15; 0 if unknown."""
    year = F.coalesce(F.substring(date, 1, 4), some(F.regexp_extract(F.coalesce(text, F.lit("")), K.SNIPPET_YEAR, 1)))
    age = as_of_year - year.try_cast("int")
    return F.when(age.isNull(), 0.0).when(age <= 1, 0.20).when(age <= 2, 0.10).when(age <= 3, 0.0).when(age <= 4, -0.10).otherwise(-0.15)


def spaced_citations(text: Column) -> Column:
    """`[1][2]` as `[1], [2]`."""
    return F.regexp_replace(text, r"(\[[0-9]+\])(?=\[[0-9]+\])", "$1, ")


def spaced_lists(text: Column) -> Column:
    """An empty line before each list item (a line that starts with a digit, a hyphen or a bullet) that follows other text."""
    return F.regexp_replace(text, r"(?U)(\S[^\S\n]*)\n(?=[^\S\n]*[\p{Nd}\-•])", "$1\n\n")


def folded(text: Column) -> Column:
    return F.translate(text, "ıçşöüğ", "icsoug")


_SCRIPT, _CONTROL, _OPENING = re.compile(K.SCRIPT_URI, re.I), re.compile(K.CONTROL_CHARACTERS), re.compile(K.FENCE_OPENING)
SAFETY_NOTE = K.SAFETY_NOTE


def fenced(text: str) -> list[str]:
    """The text in parts, fences at odd places: from an opening to the next closing behind it. Without one, no later opening has one."""
    parts, done = [], 0
    while (m := _OPENING.search(text, done)) and (end := text.find(K.FENCE_CLOSING, m.end())) >= 0:
        end += len(K.FENCE_CLOSING)
        parts += [text[done : m.start()], text[m.start() : end]]
        done = end
    return [*parts, text[done:]]


def sanitize(text: str | None, max_chars: int) -> str:
    """Plain text: entities resolved, script URIs and control characters gone, runs of spaces and empty lines shortened.

    Fenced code keeps its white space. A text over max_chars is cut, before a fence that the cut would leave open, and
    says so. Null is empty.
    """
    plain = _CONTROL.sub("", _SCRIPT.sub("", html.unescape(text or ""))).replace("\r\n", "\n").replace("\r", "\n")
    shorter = [p if i % 2 else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", p)) for i, p in enumerate(fenced(plain))]
    out = "".join(shorter).strip()
    if len(out) <= max_chars:
        return out
    head = out[:max_chars]
    if head.count("```") % 2 and (at := head.rfind("```")) > 0:
        head = head[:at].rstrip()
    return head + SAFETY_NOTE


def sanitized(text: Column, max_chars: int) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start, size in parts(texts):
                yield pa.array([sanitize(t, max_chars) for t in texts.slice(start, size).to_pylist()], pa.string())

    return run(text)
