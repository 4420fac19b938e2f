"""Analysis records: assembly, upsert, latest version, slim index and record views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions import scoring
from paperloom.functions.bilingual import bi, pick
from paperloom.functions.dates import instant
from paperloom.functions.text import filled, strip
from paperloom.operators.figures import legacy_figure
from paperloom.operators.prompts import ASPECTS
from paperloom.operators.ranking import first_per_key, positioned
from paperloom.operators.shape import explode_rows

# Stored time format, index width, section order.
STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
INDEX_AUTHORS = 6
SECTIONS = ("relevance", "brief", "core", "qa")


def merge_captions(figures: Column, translated: Column) -> Column:
    """Two-language captions by position; original only when the lengths differ."""
    aligned = F.coalesce(F.size(translated) == F.size(figures), F.lit(False))
    return F.transform(
        figures,
        lambda f, i: F.struct(
            f["label"].alias("label"),
            bi(f["caption"], F.when(aligned, F.get(translated, i))).alias("caption"),
            f["url"].alias("url"),
            f["order"].alias("order"),
            f["stage"].alias("stage"),
            f["reference_text"].alias("reference_text"),
        ),
    )


def legacy_entry(figure: Column, merged: Column) -> Column:
    """Single-figure slot, with the caption its list entry (label, order) has."""
    twin = F.get(
        F.filter(merged, lambda m: (m["label"] == figure["label"]) & (m["order"] == figure["order"])), 0
    )
    return F.when(
        figure.isNotNull(),
        F.struct(
            figure["label"].alias("label"),
            F.coalesce(twin["caption"], bi(figure["caption"])).alias("caption"),
            figure["url"].alias("url"),
            figure["reference_text"].alias("reference_text"),
        ),
    )


def merge_tasks(tasks: Column, translated: Column) -> Column:
    return F.transform(
        tasks,
        lambda t, i: F.struct(
            *[bi(t[n], F.get(translated, i)[n]).alias(n) for n in ("question", "reason")]
        ),
    )


def merge_findings(findings: Column, translated: Column) -> Column:
    """Two-language findings by position; a short list leaves the rest in the original."""
    return F.transform(
        findings,
        lambda f, i: F.struct(
            *[bi(f[n], F.get(translated, i)[n]).alias(n) for n in ("question", "reason", "answer")],
            f["confidence"].alias("confidence"),
        ),
    )


def to_payload(
    records: DataFrame, model: str | None, generated_at: datetime, keep_body: bool = False, *also: str
) -> DataFrame:
    """Stored record per paper: every text in two languages, scores, figures, findings.

    `keep_body` stores the body as ``markdown``, as single-paper runs do; `also` names
    columns to carry along.
    """
    tr = F.col("tr")
    staged = records.withColumn("_figs", merge_captions(F.col("figures"), tr["figure_captions"])).withColumn(
        "_legacy", legacy_figure(F.col("figures"))
    )
    core = F.when(
        F.col("core_summary").isNotNull(),
        F.struct(*[bi(F.col(f"core_summary.{a}"), tr["core_summary"][a]).alias(a) for a in ASPECTS]),
    )
    return staged.select(
        "arxiv_id",
        "topic",
        "topic_label",
        bi(F.col("title"), tr["title"]).alias("title"),
        "authors",
        "affiliations",
        "categories",
        F.date_format("published", ISO_FORMAT).alias("published"),
        F.date_format("updated", ISO_FORMAT).alias("updated"),
        "abstract",
        "arxiv_url",
        "pdf_url",
        "comment",
        bi(F.col("relevance"), tr["relevance"]).alias("relevance"),
        F.col("_figs").alias("figures"),
        legacy_entry(F.col("_legacy"), F.col("_figs")).alias("figure"),
        bi(F.col("brief_summary"), tr["brief_summary"]).alias("brief_summary"),
        core.alias("core_summary"),
        merge_tasks(F.col("tasks"), tr["findings"]).alias("tasks"),
        merge_findings(F.col("findings"), tr["findings"]).alias("findings"),
        scoring.normalised_score(F.col("scores")).alias("score"),
        F.col("scores").alias("score_dimensions"),
        (F.col("body") if keep_body else F.lit("")).alias("markdown"),
        F.lit(model).cast("string").alias("model"),
        F.date_format(instant(generated_at), STAMP_FORMAT).alias("generated_at"),
        *also,
    )


def payload_json(payload: DataFrame) -> DataFrame:
    """``(arxiv_id, json)`` with every key present, also when its value is null."""
    return payload.select(
        "arxiv_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")
    )


def upsert_latest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One record per id; a new one replaces the stored one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(
        both, ["arxiv_id"], [F.col("_new").desc(), F.coalesce("generated_at", F.lit("")).desc()]
    ).drop("_new")


def latest(analyses: DataFrame) -> DataFrame:
    """Latest version per id, by generation time."""
    return first_per_key(analyses, ["arxiv_id"], [F.coalesce("generated_at", F.lit("")).desc()])


def to_index(analyses: DataFrame) -> DataFrame:
    """Slim row per record: six authors, date only."""
    return analyses.select(
        "arxiv_id",
        "topic",
        "topic_label",
        "title",
        F.slice("authors", 1, INDEX_AUTHORS).alias("authors"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        F.substring("published", 1, 10).alias("published"),
        "generated_at",
    )


def get_analysis(analyses: DataFrame, paper_id: str, topic: str | None = None) -> DataFrame:
    """One record by id; none when it belongs to another topic than asked for."""
    rows = analyses.where(F.col("arxiv_id") == paper_id)
    return rows.where(F.col("topic") == topic) if topic else rows


def newest_first() -> list[Column]:
    return [F.coalesce("generated_at", F.lit("")).desc(), F.coalesce("arxiv_id", F.lit("")).desc()]


def index_positions(index: DataFrame) -> DataFrame:
    """Index rows with their place in index order."""
    return positioned(index, newest_first())


def recent_analyses(index: DataFrame, n: int = 50, topic: str | None = None) -> DataFrame:
    rows = index.where(F.col("topic") == topic) if topic else index
    return rows.orderBy(*newest_first()).limit(n)


def figures_or_legacy(figures: Column, figure: Column) -> Column:
    """Figure list; an older record's single figure becomes its methodology figure."""
    single = F.array(
        F.struct(
            figure["label"].alias("label"),
            figure["caption"].alias("caption"),
            figure["url"].alias("url"),
            F.lit(0).alias("order"),
            F.lit("methodology").alias("stage"),
            figure["reference_text"].alias("reference_text"),
        )
    )
    return (
        F.when(F.size(figures) > 0, figures)
        .when(figure.isNotNull(), single)
        .otherwise(F.slice(single, 1, 0))
    )


def availability(analyses: DataFrame, locale: str) -> DataFrame:
    """Which sections a record can show: flags, filled aspects and the flat section list."""
    names = F.array(*[F.lit(a) for a in ASPECTS])
    texts = F.array(*[strip(pick(F.col("core_summary")[a], locale)) for a in ASPECTS])
    pairs = F.zip_with(names, texts, lambda n, t: F.struct(n.alias("n"), t.alias("t")))
    aspects = F.when(
        F.col("core_summary").isNotNull(),
        F.transform(F.filter(pairs, lambda p: p["t"] != ""), lambda p: p["n"]),
    ).otherwise(F.array().cast("array<string>"))
    staged = analyses.withColumn("aspects", aspects)
    flags = {
        "relevance": pick(F.col("relevance"), locale) != "",
        "brief": pick(F.col("brief_summary"), locale) != "",
        "core": F.size("aspects") > 0,
        "qa": F.coalesce(F.size("findings") > 0, F.lit(False)),
    }
    staged = staged.select("arxiv_id", "aspects", *[c.alias(f"has_{n}") for n, c in flags.items()])
    items = F.array_compact(
        F.flatten(
            F.array(
                F.array(F.when(F.col("has_relevance"), F.lit("relevance"))),
                F.array(F.when(F.col("has_brief"), F.lit("brief"))),
                F.array(F.when(F.col("has_core"), F.lit("core"))),
                F.transform("aspects", lambda a: F.concat(F.lit("core-"), a)),
                F.array(F.when(F.col("has_qa"), F.lit("qa"))),
            )
        )
    )
    return staged.withColumn("sections", items)


def sections(analyses: DataFrame, locale: str = "en") -> DataFrame:
    """Long form ``(arxiv_id, stage, section)`` of the texts a reader can annotate."""
    qa = F.array_join(
        F.transform(
            "findings", lambda f: F.concat_ws("\n", pick(f["question"], locale), pick(f["answer"], locale))
        ),
        "\n",
    )
    parts = [
        ("relevance", pick(F.col("relevance"), locale)),
        ("brief", pick(F.col("brief_summary"), locale)),
        *[(a, pick(F.col("core_summary")[a], locale)) for a in ASPECTS],
        ("qa", qa),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), t.alias("section")) for n, t in parts])
    return explode_rows(analyses, rows, "s", ["arxiv_id"]).select("arxiv_id", "s.*").where(
        filled(F.col("section")).isNotNull()
    )
