"""Scoring, thresholds, de-duplication and first-topic-wins assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.config import Topic, TriageConfig, topics_df
from paperloom.functions import ids, scoring
from paperloom.functions.dates import day, instant
from paperloom.operators.candidates import with_topics
from paperloom.operators.ranking import first_per_key, top_per_group
from paperloom.operators.shape import compute_once
from paperloom.session import counted, materialise

# The placeholder a topic without candidates gets.
DEMO_ID_PREFIX = "demo-"
DEMO_AUTHOR = "Triage Bot"
DEMO_AFFILIATION = "Triage Project"
DEMO_CATEGORY = "cs.AI"
DEMO_ABSTRACT = (
    "Placeholder record that lets a run go through without input. Topic: {label}."
    " Keywords: {keywords}. Categories: {categories}."
)


def score_candidates(
    candidates: DataFrame, conf: TriageConfig, overrides: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add ``scores``, ``total_score`` and ``score`` (0-100) by keyword rules."""
    joined = with_topics(candidates, conf.topics)
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("abstract")))
    scored = compute_once(
        joined.withColumn("_text", text),
        "scores",
        scoring.offline_scores(
            conf.dimensions,
            F.col("_text"),
            F.col("include"),
            F.col("topic_categories"),
            F.col("interest_prompt"),
            conf.novelty_words,
            conf.experiment_words,
            overrides,
        ),
    )
    return with_totals(scored.drop("_text"))


def with_totals(scored: DataFrame) -> DataFrame:
    return scored.withColumn("total_score", scoring.total_score(F.col("scores"))).withColumn(
        "score", scoring.normalised_score(F.col("scores"))
    )


def passing(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= F.lit(float(threshold)))


def unseen(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates whose id no earlier run handled.  The manifest grows, so it is not broadcast."""
    return candidates.join(manifest.select("arxiv_id"), "arxiv_id", "left_anti")


def seen_ids(manifest: DataFrame, selected: DataFrame) -> DataFrame:
    return manifest.select("arxiv_id").union(selected.select("arxiv_id")).distinct()


def dedup_counts(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates before and after the manifest, per topic."""
    known = manifest.select("arxiv_id").distinct().withColumn("_known", F.lit(True))
    return (
        candidates.select("topic_idx", "arxiv_id")
        .join(known, "arxiv_id", "left")
        .groupBy("topic_idx")
        .agg(F.count("*").alias("before"), F.count_if(F.col("_known").isNull()).alias("after"))
    )


def assign(passed: DataFrame) -> DataFrame:
    """Each paper stays with the first (window, topic) where it passed."""
    order = [F.col("window_idx"), F.col("topic_idx"), F.col("published").desc()]
    return first_per_key(passed, ["arxiv_id"], order)


def assign_with_limit(scored: DataFrame, conf: TriageConfig, limit: int) -> DataFrame:
    """The same with at most `limit` candidates looked at per window and topic.

    The limit counts candidates that no earlier (window, topic) selected.  All of them
    propose their head at once and each paper stays with its earliest proposal; heads
    are drawn again without the papers that others hold, until nothing moves.  A step
    depends on earlier ones only, so the first that was wrong is right a round later, and
    the end is what taking the steps one by one would give; a round is one job for all.
    Rounds see ids, dates and scores only and write at most `limit` rows a step; the
    chosen rows are met with their texts once, at the end.
    """
    spark = scored.sparkSession
    slim = materialise(scored.select("arxiv_id", "window_idx", "topic_idx", "published", "score"), "candidates")
    step = F.struct("window_idx", "topic_idx")
    order = [F.col("published").desc(), F.col("arxiv_id"), F.col("score").desc()]
    held = spark.createDataFrame([], T.StructType([slim.schema["arxiv_id"], T.StructField("holder", slim.select(step.alias("s")).schema["s"].dataType)]))
    last = None
    while True:
        free = slim.join(counted(held), "arxiv_id", "left").where(F.col("holder").isNull() | (F.col("holder") >= step))
        heads = top_per_group(free.select(slim.columns), ["window_idx", "topic_idx"], order, limit).select(slim.columns)
        proposed = materialise(passing(heads, conf.pass_threshold), "proposed")
        held = materialise(proposed.groupBy("arxiv_id").agg(F.min(step).alias("holder")), "held")
        state = held.agg(F.count("*"), F.sum(F.xxhash64("arxiv_id", "holder").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    chosen = proposed.join(held, "arxiv_id").where(F.col("holder") == step).select(slim.columns)
    return scored.join(counted(chosen.distinct()), slim.columns, "left_semi").select(scored.columns)


def preview(candidates: DataFrame) -> DataFrame:
    """Dry run: new candidates per window and topic, each id once, with subtotals and a total."""
    order = [F.col("window_idx"), F.col("topic_idx")]
    once = first_per_key(candidates.select("arxiv_id", "window_idx", "topic_idx"), ["arxiv_id"], order)
    return once.rollup("window_idx", "topic_idx").agg(F.count("*").alias("n"))


def run_stats(scored: DataFrame, n_topics: int, threshold: float, known: Column | None = None) -> DataFrame:
    """Topics processed, candidates fetched (before de-duplication) and papers selected.

    One pass over the scored candidates.  A paper counts as selected once, by the first
    topic it passes; `known` marks ids an earlier run handled.
    """
    chosen = F.col("score") >= F.lit(float(threshold))
    if known is not None:
        chosen = chosen & ~known
    return scored.agg(
        F.lit(n_topics).cast("bigint").alias("topics_processed"),
        F.count("*").alias("papers_fetched"),
        F.count_distinct(F.when(chosen, F.col("arxiv_id"))).alias("papers_selected"),
    )


def fill_empty(candidates: DataFrame, topics: Sequence[Topic], run_ts: datetime) -> DataFrame:
    """Placeholder candidates for topics that found nothing, in the candidates' columns."""
    spark = candidates.sparkSession
    present = candidates.select("topic_idx").distinct()
    empty = topics_df(spark, topics).join(present, "topic_idx", "left_anti")
    keywords = F.when(F.size("include") > 0, F.col("include")).otherwise(F.array("topic_label"))
    cats = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(DEMO_CATEGORY)))
    abstract = F.lit(DEMO_ABSTRACT)
    for mark, value in (
        ("{label}", F.col("topic_label")),
        ("{keywords}", F.array_join(keywords, ", ")),
        ("{categories}", F.array_join(cats, ", ")),
    ):
        abstract = F.replace(abstract, F.lit(mark), value)
    stamp = F.date_format(instant(run_ts), "HHmmss")
    made = {
        "topic_idx": F.col("topic_idx"),
        "window_idx": F.lit(0),
        "arxiv_id": F.concat(F.lit(DEMO_ID_PREFIX), F.col("topic"), F.lit("-"), stamp),
        "title": F.concat(F.lit("[Demo] "), F.col("topic_label"), F.lit(" Automated Test Example")),
        "abstract": abstract,
        "authors": F.array(F.lit(DEMO_AUTHOR)),
        "affiliations": F.array(F.lit(DEMO_AFFILIATION)),
        "categories": cats,
        "published": instant(run_ts),
        "updated": instant(run_ts),
        "arxiv_url": ids.abs_url(F.lit("0000.00000")),
    }
    rows = empty.select(
        *[
            made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in candidates.schema.fields
        ]
    )
    return candidates.unionByName(rows)


def index_rows(selected: DataFrame) -> DataFrame:
    """The slim columns of selected papers."""
    return selected.select(
        "arxiv_id", "topic", "topic_label", "title", "score", day(F.col("published")).alias("published")
    )
