"""Plain-text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Whitespace that counts for trimming, sentence ends, separators.
BLANKS = " \t\n\r\u000b\f"
SENTENCE_BREAK = r"(?<=[。！？.!?])\s+"
ASCII_SENTENCE_BREAK = r"(?<=[.!?])\s+"
KEYWORD_BREAK = r"[,，;；]"
TRUNCATION_MARK = "\n\n... (内容截断)"
ELLIPSIS = "…"
PARAGRAPH_BREAK = "<br/><br/>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    A column captured by a lambda runs again for every array element; a lambda
    variable does not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(col: Column) -> Column:
    """Trim every kind of ASCII white space (Spark's ``trim`` only takes blanks)."""
    return F.btrim(col, F.lit(BLANKS))


def filled(col: Column) -> Column:
    """Null for an empty string, so ``coalesce`` treats it as missing."""
    return F.nullif(col, F.lit(""))


def squeeze(col: Column) -> Column:
    """Collapse each run of white space to one blank and trim."""
    return strip(F.regexp_replace(col, r"\s+", " "))


def truncate(col: Column, limit: int, mark: str = TRUNCATION_MARK) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit(mark))).otherwise(col)


def excerpt(col: Column, limit: int) -> Column:
    """Cut with a one-character ellipsis."""
    return truncate(col, limit, ELLIPSIS)


def escape_html(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def html_paragraphs(col: Column, limit: int) -> Column:
    """Cut to `limit`, then escape, then join paragraphs with a break tag."""
    plain = strip(col)
    plain = F.when(
        F.length(plain) > limit,
        F.concat(F.rtrim(F.substring(plain, 1, limit), F.lit(BLANKS)), F.lit(ELLIPSIS)),
    ).otherwise(plain)
    paragraphs = F.filter(F.transform(F.split(plain, "\n\n"), strip), lambda p: p != "")
    safe = F.transform(paragraphs, lambda p: escape_html(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(safe, PARAGRAPH_BREAK)


def sentences(col: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(col, r"\s+", " "), SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: s != "")


def brief_from_abstract(col: Column) -> Column:
    """Sentences 1-3 and 4-6 as two paragraphs; 400 characters when there is no sentence."""
    parts = F.filter(F.split(col, ASCII_SENTENCE_BREAK), lambda s: strip(s) != "")
    first = strip(F.array_join(F.slice(parts, 1, 3), " "))
    second = strip(F.array_join(F.slice(parts, 4, 3), " "))
    return (
        F.when(F.size(parts) == 0, F.substring(strip(col), 1, 400))
        .when(second != "", F.concat(first, F.lit("\n\n"), second))
        .otherwise(first)
    )


def question_keywords(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, KEYWORD_BREAK), strip), lambda k: k != "")


def strip_quotes(col: Column) -> Column:
    return F.btrim(col, F.lit("\"' "))


def strip_label(caption: Column, label: Column) -> Column:
    """Drop a caption's leading label, which is shown on its own."""
    trimmed = strip(caption)
    rest = F.substring(trimmed, F.length(label) + 1, F.length(trimmed))
    return F.when(
        F.startswith(trimmed, label), strip(F.regexp_replace(rest, r"^[\s:：.-]+", ""))
    ).otherwise(trimmed)


def short_list(items: Column, keep: int, more: str = " et al.") -> Column:
    """First `keep` entries joined by commas, marked when there are more."""
    head = F.array_join(F.slice(items, 1, keep), ", ")
    return F.when(F.size(items) > keep, F.concat(head, F.lit(more))).otherwise(head)


def byline(authors: Column, affiliations: Column) -> Column:
    """Three authors, then the first affiliation with the number of others."""
    who = F.when(F.size(authors) > 0, short_list(authors, 3))
    where = F.when(
        F.size(affiliations) > 0,
        F.concat(
            F.get(affiliations, 0),
            F.when(
                F.size(affiliations) > 1,
                F.concat(F.lit(" +"), (F.size(affiliations) - 1).cast("string")),
            ).otherwise(F.lit("")),
        ),
    )
    return F.concat_ws(" · ", who, where)
