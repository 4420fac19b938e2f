"""Per-run digest (HTML) and per-paper report (Markdown)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import ids
from paperloom.functions.bilingual import LABELS, fill_template, label, pick
from paperloom.functions.scoring import one_decimal, two_decimals
from paperloom.functions.text import byline, escape_html, filled, html_paragraphs, strip
from paperloom.operators.prompts import ASPECTS

# Lengths of the two card texts, report headings.
NOTE_CHARS = 320
BRIEF_CHARS = 300
SCORES_HEADING = "### 📊 Relevance Scores"
CORE_HEADING = "## 论文核心内容"
ASPECT_HEADINGS = (
    "### 1. 主要解决了什么问题？",
    "### 2. 提出了什么解决方案？",
    "### 3. 核心方法/步骤/策略",
    "### 4. 实验设计",
    "### 5. 结论",
)
QA_HEADING = "## Questions & Answers"

SITE_NAME = "Paperloom"


def digest_stats(analyses: DataFrame) -> DataFrame:
    return analyses.agg(
        F.count("*").alias("papers"),
        F.count_distinct("topic_label").alias("topics"),
        F.avg("score").alias("avg_score"),
    )


def digest_groups(analyses: DataFrame) -> DataFrame:
    """Papers per topic label with the position of the label's first paper.

    `analyses` carries ``pos``, the order of the run.
    """
    return analyses.groupBy("topic_label").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def cards(analyses: DataFrame, language: str, site_base_url: str = "") -> DataFrame:
    """Card fields: link, escaped title, byline, note, brief and one-decimal score.

    Titles stay English; note and brief follow the reader's language.
    """
    lang = "en" if language.lower().startswith("en") else "zh-CN"
    return analyses.select(
        *[c for c in ("pos",) if c in analyses.columns],
        "arxiv_id",
        "topic_label",
        escape_html(ids.page_link(site_base_url, F.col("arxiv_id"), F.col("arxiv_url"))).alias("url"),
        escape_html(F.coalesce(filled(F.col("title.en")), F.col("arxiv_id"))).alias("title"),
        escape_html(byline(F.col("authors"), F.col("affiliations"))).alias("byline"),
        html_paragraphs(strip(pick(F.col("relevance"), lang)), NOTE_CHARS).alias("note"),
        html_paragraphs(pick(F.col("brief_summary"), lang), BRIEF_CHARS).alias("brief"),
        one_decimal(F.col("score")).alias("score"),
    )


def card_html(language: str) -> Column:
    lang = F.lit("en" if language.lower().startswith("en") else "zh-CN")

    def text(key: str) -> Column:
        return escape_html(label(F.lit(key), lang))

    return F.concat(
        F.lit('<div class="card"><h3><a href="'), F.col("url"), F.lit('">'), F.col("title"), F.lit("</a></h3>"),
        F.when(F.col("byline") != "", F.concat(F.lit('<p class="by">'), F.col("byline"), F.lit("</p>"))).otherwise(""),
        F.when(
            F.col("note") != "",
            F.concat(F.lit('<p class="why"><b>'), text("why_matters"), F.lit("</b> "), F.col("note"), F.lit("</p>")),
        ).otherwise(""),
        F.when(F.col("brief") != "", F.concat(F.lit('<p class="brief">'), F.col("brief"), F.lit("</p>"))).otherwise(""),
        F.lit('<p class="foot">'), text("relevance"), F.lit(": <strong>"), F.col("score"),
        F.lit('</strong> <a href="'), F.col("url"), F.lit('">'), text("view_details"), F.lit("</a></p></div>"),
    )


def digest_lines(
    analyses: DataFrame, language: str, run_ts: datetime, site_base_url: str = "", subject: str = ""
) -> DataFrame:
    """The digest document as ordered fragments ``(part, first_pos, pos, html)``.

    Sorting by the first three columns gives the document, so a long one is written by
    many tasks and never put together in one.  ``part`` is 0 for head and statistics,
    1 for topics and cards, 2 for the foot.
    """
    lang = F.lit("en" if language.lower().startswith("en") else "zh-CN")
    run_date = f"{run_ts:%Y-%m-%d}"

    def text(key: str) -> Column:
        return escape_html(label(F.lit(key), lang))

    def row(df: DataFrame, part: int, html: Column, first: Column | None = None, pos: Column | None = None) -> DataFrame:
        minus = F.lit(-1).cast("bigint")
        return df.select(
            F.lit(part).alias("part"),
            (minus if first is None else first).cast("bigint").alias("first_pos"),
            (minus if pos is None else pos).cast("bigint").alias("pos"),
            html.alias("html"),
        )

    stats = digest_stats(analyses)
    own = F.lit(subject.strip()) if subject.strip() else label(F.lit("subject"), lang)
    title = fill_template(own, run_date=F.lit(run_date), paper_count=F.col("papers"))
    link = F.lit(site_base_url.rstrip("/"))
    head = row(
        stats,
        0,
        F.concat(
            F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape_html(title),
            F.lit(f"</title></head><body><h1>{SITE_NAME}</h1><p>"), text("subtitle"), F.lit("</p>"),
            F.when(
                F.col("papers") > 0,
                F.concat(
                    F.lit("<ul><li>"), F.col("papers").cast("string"), F.lit(" "), text("stat_papers"),
                    F.lit("</li><li>"), F.col("topics").cast("string"), F.lit(" "), text("stat_topics"),
                    F.lit("</li><li>"), one_decimal(F.coalesce("avg_score", F.lit(0.0))), F.lit(" "),
                    text("stat_avg"), F.lit("</li></ul>"),
                ),
            ).otherwise(F.concat(F.lit("<p>"), text("empty"), F.lit("</p>"))),
            F.when(
                link != "",
                F.concat(F.lit('<p><a href="'), escape_html(link), F.lit('">'), text("view_report"), F.lit("</a></p>")),
            ).otherwise(""),
        ),
    )
    groups = digest_groups(analyses)
    badge = fill_template(label(F.lit("papers_badge"), lang), n=F.col("n"))
    topics = row(
        groups,
        1,
        F.concat(
            F.lit("<h2>"), escape_html(F.coalesce("topic_label", F.lit(""))), F.lit(" <small>"), escape_html(badge),
            F.lit("</small></h2>"),
        ),
        F.col("first_pos"),
    )
    made = cards(analyses, language, site_base_url).join(
        groups.select(F.col("topic_label").alias("_label"), "first_pos"), F.col("topic_label").eqNullSafe(F.col("_label"))
    )
    body = row(made, 1, card_html(language), F.col("first_pos"), F.col("pos"))
    foot = row(
        stats,
        2,
        F.concat(F.lit("<footer>"), text("updated"), F.lit(f" {run_date}</footer></body></html>")),
    )
    return head.unionByName(topics).unionByName(body).unionByName(foot)


def subject_line(papers: Column, run_ts: datetime, language: str, template: str = "") -> Column:
    lang = "en" if language.lower().startswith("en") else "zh-CN"
    own = template.strip() or LABELS["subject"][lang]
    return fill_template(F.lit(own), run_date=F.lit(f"{run_ts:%Y-%m-%d}"), paper_count=papers)


def report_markdown(records: DataFrame, run_ts: datetime) -> DataFrame:
    """One Markdown report per paper: ``(arxiv_id, report)``."""
    quotes = F.transform(
        F.filter(F.transform(F.split(F.coalesce("brief_summary", F.lit("")), "\n\n"), strip), lambda p: p != ""),
        lambda p: F.concat(F.lit("> "), F.replace(p, F.lit("\n"), F.lit(" "))),
    )
    scores = F.transform(
        "scores",
        lambda s: F.concat(
            F.lit("- **"), s["name"], F.lit("**: "), one_decimal(s["value"] * 100.0), F.lit("/100 (weight: "),
            two_decimals(s["weight"]), F.lit(")"),
        ),
    )
    core = F.array(F.lit(CORE_HEADING), F.lit(""))
    for heading, aspect in zip(ASPECT_HEADINGS, ASPECTS):
        core = F.concat(core, F.array(F.lit(heading), F.col(f"core_summary.{aspect}"), F.lit("")))
    qa = F.flatten(
        F.transform(
            "findings",
            lambda f: F.array(
                F.concat(F.lit("### "), f["question"]),
                strip(f["answer"]),
                F.concat(F.lit("*Confidence: "), two_decimals(f["confidence"]), F.lit("*\n")),
            ),
        )
    )
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.col("title")), F.lit("")),
        F.when(F.size(quotes) > 0, F.concat(quotes, F.array(F.lit("")))).otherwise(none),
        F.array(
            F.concat(F.lit("**Topic**: "), F.col("topic_label")),
            F.concat(F.lit("**arXiv**: ["), F.col("arxiv_id"), F.lit("]("), F.col("arxiv_url"), F.lit(")")),
            F.concat(F.lit("**Authors**: "), F.array_join("authors", ", ")),
            F.concat(F.lit("**Published**: "), F.date_format("published", "yyyy-MM-dd")),
            F.concat(F.lit("**Score**: "), one_decimal(F.col("score"))),
            F.lit(""),
            F.lit(SCORES_HEADING),
        ),
        scores,
        F.array(F.lit("")),
        F.when(F.col("core_summary").isNotNull(), core).otherwise(none),
        F.array(F.lit(QA_HEADING)),
        qa,
        F.array(F.lit("---"), F.lit(f"*Generated at {run_ts:%Y-%m-%d %H:%M} UTC*")),
    )
    return records.select("arxiv_id", F.array_join(lines, "\n").alias("report"))
