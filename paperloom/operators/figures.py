"""Body text and figures, from page HTML or from a table of text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.config import DEFAULT_PAGE_CHARS
from paperloom.functions import html
from paperloom.functions.replies import KEPT_STAGES
from paperloom.functions.text import filled, squeeze, strip, truncate
from paperloom.operators.ranking import first_per_key, number_within, top_per_group
from paperloom.operators.shape import compute_once, explode_rows, posexplode_rows

# Fixed value: figures kept per paper.
MAX_FIGURES = 8


def page_text(pages: DataFrame, max_chars: int | None = DEFAULT_PAGE_CHARS) -> DataFrame:
    """Readable text per page, cut with a marker when `max_chars` is given."""
    out = compute_once(pages, "body", html.page_text(F.col("html")))
    return out.withColumn("body", truncate(F.col("body"), max_chars)) if max_chars else out


def page_blocks(pages: DataFrame) -> DataFrame:
    """Paragraphs of a page in order: ``(page_id, pos, text)``."""
    return posexplode_rows(pages, html.paragraphs(F.col("html")), "pos", "text", ["page_id"])


def page_links(pages: DataFrame) -> DataFrame:
    """Links of a page in order, resolved against its address."""
    anchors = F.transform(
        html.elements(F.col("html"), "a"), lambda e: html.attribute(e["attrs"], "href")
    )
    links = posexplode_rows(pages, anchors, "pos", "href", ["page_id", "url"])
    return links.where(F.col("href").isNotNull()).select(
        "page_id", "pos", html.resolve_url(F.col("href"), F.col("url")).alias("link")
    )


def with_figures(pages: DataFrame, cap: int | None = MAX_FIGURES) -> DataFrame:
    """Add ``figures`` to each page, the first `cap` in page order."""
    found = html.figures(F.col("html"), F.col("url"))
    return compute_once(pages, "figures", F.slice(found, 1, cap) if cap else found)


def figure_rows(pages: DataFrame) -> DataFrame:
    """Long form: one row per figure."""
    found = html.figures(F.col("html"), F.col("url"))
    return explode_rows(pages, found, "f", ["page_id"]).select("page_id", "f.*")


def best_figure(figures: Column) -> Column:
    """The most explanatory figure of an array; the earliest wins a tie."""
    ranked = F.transform(
        figures,
        lambda f: F.struct(
            html.figure_rank(f["order"], f["caption"]).alias("rank"), (-f["order"]).alias("neg"), f.alias("figure")
        ),
    )
    return F.array_max(ranked)["figure"]


def kept_figures(figures: Column) -> Column:
    """Figures with a stage that is shown."""
    return F.filter(figures, lambda f: f["stage"].isin(*KEPT_STAGES))


def legacy_figure(figures: Column) -> Column:
    """First methodology figure, else the first one, else null."""
    method = F.filter(figures, lambda f: f["stage"] == "methodology")
    return F.coalesce(F.get(method, 0), F.get(figures, 0))


def block_captions(blocks: DataFrame, cap: int | None = None) -> DataFrame:
    """Captions among text blocks, the first per page and number, numbered per document.

    `blocks` has ``doc_id, page, y0, text``.  Numbering goes by page and height.  With
    `cap` only the first captions of a document are kept, which needs one pass; without
    it all are numbered page by page, which reads the blocks twice.
    """
    trimmed = blocks.select("doc_id", "page", "y0", strip(F.col("text")).alias("text"))
    named = compute_once(trimmed, "num", html.caption_number(F.col("text"))).where(F.col("num").isNotNull())
    first = first_per_key(named, ["doc_id", "page", "num"], [F.col("y0"), F.col("text")])
    if cap is None:
        numbered = number_within(first, ["doc_id"], "page", [F.col("y0"), F.col("num")], "order")
    else:
        top = top_per_group(first, ["doc_id"], [F.col("page"), F.col("y0"), F.col("num")], cap)
        numbered = top.withColumn("order", F.col("rank") - 1)
    return numbered.select(
        "doc_id",
        "page",
        "num",
        F.col("order").cast("int").alias("order"),
        F.concat(F.lit("Figure "), F.col("num").cast("string")).alias("label"),
        html.caption_body(F.col("text")).alias("caption"),
    )


def block_references(blocks: DataFrame) -> DataFrame:
    """Per document and figure number, the first three blocks that cite it, joined.

    The three are chosen before anything meets the figures, so a number cited all over
    a long document costs three rows per task.
    """
    flat = blocks.select("doc_id", "page", "y0", squeeze(F.col("text")).alias("text")).where(
        (F.length("text") >= html.MIN_PARAGRAPH) & html.caption_number(F.col("text")).isNull()
    )
    cites = explode_rows(flat, html.cited_numbers(F.col("text")), "num_text").withColumn(
        "num", F.col("num_text").try_cast("int")
    )
    top = top_per_group(
        cites.where(F.col("num_text") == F.col("num").cast("string")),
        ["doc_id", "num"],
        [F.col("page"), F.col("y0"), F.col("text")],
        html.MAX_REFERENCES,
    )
    joined = top.groupBy("doc_id", "num").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_t"))
    text = F.array_join(F.transform("_t", lambda t: t["text"]), "\n\n")
    return joined.select("doc_id", "num", F.substring(text, 1, html.MAX_REFERENCE_CHARS).alias("reference_text"))


def block_figures(blocks: DataFrame, cap: int | None = None) -> DataFrame:
    """Captions with what the document says about them."""
    refs = block_references(blocks)
    return block_captions(blocks, cap).join(refs, ["doc_id", "num"], "left").withColumn(
        "reference_text", F.coalesce("reference_text", F.lit(""))
    )


def block_figure_arrays(blocks: DataFrame, cap: int = MAX_FIGURES) -> DataFrame:
    """``(doc_id, figures)`` in the shape page figures have; blocks carry no image address."""
    rows = block_figures(blocks, cap).withColumn("url", F.lit(""))
    return fold_figures(rows, "doc_id", cap)


def cap_figures(figures: DataFrame, key: str, cap: int = MAX_FIGURES) -> DataFrame:
    """First `cap` figure rows per paper."""
    return top_per_group(figures, [key], [F.col("order")], cap, "_n").drop("_n")


def fold_figures(figures: DataFrame, key: str, cap: int = MAX_FIGURES) -> DataFrame:
    """Figure rows to one array per paper, in order and at most `cap` long."""
    cols = ["order", "label", "caption", "url", "reference_text"]
    return (
        cap_figures(figures, key, cap)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("figures"))
    )


def figure_source(from_html: DataFrame, from_blocks: DataFrame, key: str) -> DataFrame:
    """Figures from HTML; a paper without any takes the ones from its blocks."""
    rest = from_blocks.join(from_html.select(key).distinct(), key, "left_anti")
    return from_html.unionByName(rest.select(from_html.columns))


def with_body(papers: DataFrame, page_bodies: DataFrame, other_texts: DataFrame) -> DataFrame:
    """Body text: page text, else the alternative text, else the abstract.

    Both inputs have one row per ``arxiv_id`` in a column ``text``.
    """
    return (
        papers.join(page_bodies.select("arxiv_id", F.col("text").alias("_page")), "arxiv_id", "left")
        .join(other_texts.select("arxiv_id", F.col("text").alias("_other")), "arxiv_id", "left")
        .withColumn("body", F.coalesce(filled(F.col("_page")), filled(F.col("_other")), F.col("abstract")))
        .withColumn(
            "body_source",
            F.when(filled(F.col("_page")).isNotNull(), "page")
            .when(filled(F.col("_other")).isNotNull(), "other")
            .otherwise("abstract"),
        )
        .drop("_page", "_other")
    )
