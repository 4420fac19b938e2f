"""The batch run: match, rank, de-duplicate, score, select, analyse, store, digest."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from paperloom.config import Topic, TriageConfig
from paperloom.operators import analyses as A
from paperloom.operators import candidates as C
from paperloom.operators import digest, figures, intake, prompts as P, replies as R, selection as S
from paperloom.session import counted, materialise
from paperloom.sources import sinks


def candidates(
    papers: DataFrame,
    conf: TriageConfig,
    run_ts: datetime,
    window: tuple[datetime, datetime, int] | None = None,
) -> DataFrame:
    """Newest candidates per window and topic.

    Without `window` the run looks back ``days_back`` days.  With ``(start, end, days)``
    all windows are one job, with the window as a column.
    """
    base = C.with_id(papers)
    if window is None:
        placed = C.single_window(C.recent(base, run_ts, conf.days_back))
    else:
        placed = C.window_candidates(base, *window)
    matched = C.topic_candidates(placed, conf.topics)
    return matched if conf.max_per_topic is None else C.top_recent(matched, conf.max_per_topic).drop("rank")


def select(
    papers: DataFrame,
    conf: TriageConfig,
    run_ts: datetime,
    *,
    manifest: DataFrame | None = None,
    window: tuple[datetime, datetime, int] | None = None,
    replies: DataFrame | None = None,
) -> DataFrame:
    """Papers that passed, each with its first topic, scores and score.

    `manifest` holds the ids earlier runs handled; leave it out to analyse them again.
    """
    found = candidates(papers, conf, run_ts, window)
    if manifest is not None:
        found = S.unseen(found, manifest)
    scored = S.score_candidates(found, conf)
    if replies is not None:
        scored = R.relevance(scored, replies, conf.dimensions, "arxiv_id", "topic_idx")
    if conf.paper_limit is not None:
        return S.assign_with_limit(scored, conf, conf.paper_limit)
    return S.assign(S.passing(scored, conf.pass_threshold))


def analyse(
    selected: DataFrame,
    conf: TriageConfig,
    pages: DataFrame | None = None,
    other_texts: DataFrame | None = None,
    replies: Mapping[str, DataFrame] | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Full records for selected papers.

    `pages` has ``arxiv_id, url, html``; `blocks` has ``arxiv_id, page, y0, text`` and
    gives figures to papers whose page has none.  `replies` maps a step (core, profile,
    questions, answer, findings, brief, note, translate) to its reply table; a step
    without one uses its rule.
    """
    spark = selected.sparkSession
    have = dict(replies or {})
    # matching and scoring all papers happens once; below, only what was selected is read
    selected = materialise(selected, "selected")
    chosen = counted(selected.select("arxiv_id").distinct())
    none = spark.createDataFrame([], "arxiv_id string, text string")
    fig_type = "array<struct<order:int,label:string,caption:string,url:string,reference_text:string>>"
    if pages is None:
        rows = figures.with_body(selected, none, none if other_texts is None else other_texts)
        rows = rows.withColumn("figures", F.array().cast(fig_type))
    else:
        # text and figures in one pass over the HTML, only for selected papers
        wanted = pages.join(chosen, "arxiv_id", "left_semi")
        read = figures.with_figures(figures.page_text(wanted, conf.page_chars)).select(
            "arxiv_id", F.col("body").alias("text"), "figures"
        )
        rows = selected.join(read.withColumnRenamed("text", "_page"), "arxiv_id", "left")
        other = none if other_texts is None else other_texts
        rows = (
            rows.join(other.select("arxiv_id", F.col("text").alias("_other")), "arxiv_id", "left")
            .withColumn("body", F.coalesce(F.nullif("_page", F.lit("")), F.nullif("_other", F.lit("")), "abstract"))
            .withColumn("figures", F.coalesce("figures", F.array().cast(fig_type)))
            .drop("_page", "_other")
        )
    if blocks is not None:
        wanted_blocks = blocks.join(chosen, "arxiv_id", "left_semi")
        found = figures.block_figure_arrays(wanted_blocks.withColumnRenamed("arxiv_id", "doc_id"))
        rows = (
            rows.join(found.select(F.col("doc_id").alias("arxiv_id"), F.col("figures").alias("_found")), "arxiv_id", "left")
            .withColumn("figures", F.when(F.size("figures") > 0, F.col("figures")).otherwise(F.coalesce("_found", "figures")))
            .drop("_found")
        )
    rows = R.core(rows, have.get("core"))
    rows = R.interest_profiles(rows, have.get("profile"), conf.topics)
    rows = R.questions(rows, have.get("questions"))
    rows = R.answers(rows, have.get("answer"))
    rows = R.findings_summary(rows, have.get("findings"))
    rows = R.brief_summary(rows, have.get("brief"))
    rows = R.relevance_note(rows, have.get("note"))
    return R.translation(rows, have.get("translate"), conf.language)


def body_prompts(records: DataFrame, conf: TriageConfig) -> dict[str, DataFrame]:
    """Prompts that carry the paper's text, up to the configured length: ``core`` and ``answer``.

    Texts are cut in the prompt only; records keep them whole.
    """
    return {"core": P.core(records, conf.max_content_chars), "answer": P.answers(records, conf.max_content_chars)}


def single_paper(
    papers: DataFrame, raw_id: str, topic_name: str | None, conf: TriageConfig
) -> DataFrame:
    """One submitted paper, scored against one topic but never filtered."""
    topics = list(conf.topics) or [intake.ADHOC_TOPIC]
    chosen = 0
    for i, topic in enumerate(topics):
        if topic_name and topic_name in (topic.name, topic.display):
            chosen = i
            break
    one = TriageConfig(**{**conf.__dict__, "topics": (topics[chosen],)})
    row = C.single_window(C.fetch_one(papers, raw_id)).withColumn("topic_idx", F.lit(0))
    return S.score_candidates(row, one)


def dispatched(
    submissions: DataFrame, papers: DataFrame, analysed: DataFrame, topics: list[Topic], conf: TriageConfig
) -> DataFrame:
    """All new submissions at once: scored against the topic they asked for, not filtered.

    `submissions` has ``sub_id, raw, topic``; a paper submitted twice is scored once.
    """
    if not topics:
        topics = [intake.ADHOC_TOPIC]
        conf = TriageConfig(**{**conf.__dict__, "topics": tuple(topics)})
    todo = intake.triage(submissions, analysed).where(F.col("status") == "dispatched")
    asked = todo.withColumn("topic_idx", intake.resolve_topic(F.col("topic"), topics)).groupBy("arxiv_id").agg(
        F.min_by("topic_idx", "sub_id").alias("topic_idx")
    )
    # few submissions meet all papers, so they go to the papers and not the other way
    asked = counted(materialise(asked, "asked"))
    return S.score_candidates(C.single_window(papers.join(asked, "arxiv_id")), conf)


def publish(
    records: DataFrame, path: str, conf: TriageConfig, model: str | None, run_ts: datetime, keep_body: bool = False
) -> DataFrame:
    """Store records and index, write the digest of this run, return the stored table."""
    spark = records.sparkSession
    tag = f"{run_ts:%Y%m%dT%H%M%S}"  # a run that is published again replaces what it stored
    run = f"{path}/runs/{tag}"
    # order of the run: window, topic, newest first; the id only has to grow with it
    ordered = records.orderBy("window_idx", "topic_idx", F.col("published").desc(), "arxiv_id").withColumn(
        "pos", F.monotonically_increasing_id()
    )
    payload = A.to_payload(ordered, model, run_ts, keep_body, "pos")
    payload.write.mode("overwrite").parquet(run)  # computed once, read by all three outputs
    fresh = spark.read.parquet(run)
    stored = sinks.upsert_analyses(fresh.drop("pos"), f"{path}/analyses", tag=tag)
    sinks.update_index(fresh, f"{path}/index", tag=tag)
    lines = digest.digest_lines(fresh, conf.language, run_ts, conf.site_base_url)
    sinks.write_digest(lines, f"{path}/digest/{tag}")
    return stored
