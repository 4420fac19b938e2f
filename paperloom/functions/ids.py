"""Identifier rules.  Three of them, because feeds, typed ids and free text disagree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperloom.functions.text import strip

# Identifier patterns and public address formats.
MODERN_ID = r"(\d{4}\.\d{4,5})(v\d+)?"
LEGACY_ID = r"([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?"
ABS_URL = "https://arxiv.org/abs/"
PDF_URL = "https://arxiv.org/pdf/"


def feed_id(url: Column) -> Column:
    """Last path segment, cut at its first ``v``."""
    return F.substring_index(F.substring_index(url, "/", -1), "v", 1)


def typed_id(raw: Column) -> Column:
    """A typed id without a trailing version."""
    return F.regexp_replace(strip(raw), r"v\d+$", "")


def find_id(text: Column) -> Column:
    """First identifier anywhere in `text`, new style before old style, else null."""
    modern = F.nullif(F.regexp_extract(text, MODERN_ID, 1), F.lit(""))
    legacy = F.nullif(F.regexp_extract(text, LEGACY_ID, 1), F.lit(""))
    return F.coalesce(modern, legacy)


def abs_url(paper_id: Column) -> Column:
    return F.concat(F.lit(ABS_URL), paper_id)


def pdf_url(paper_id: Column) -> Column:
    return F.concat(F.lit(PDF_URL), paper_id, F.lit(".pdf"))


def page_link(base_url: str, paper_id: Column, fallback_url: Column) -> Column:
    """Link to a paper's page on the site, or its own URL when there is no site."""
    base = base_url.rstrip("/")
    if base:
        return F.concat(F.lit(base + "/papers/"), paper_id)
    return F.coalesce(F.nullif(fallback_url, F.lit("")), F.lit("#"))
