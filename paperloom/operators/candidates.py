"""From papers to per-topic candidates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.config import DEFAULT_CATEGORY_SCOPE, Topic, topics_df
from paperloom.functions.dates import instant, windows_at
from paperloom.functions.ids import typed_id
from paperloom.operators.ranking import top_per_group
from paperloom.operators.shape import explode_rows


def with_id(papers: DataFrame) -> DataFrame:
    """Drop rows that carry no identifier."""
    return papers.where(F.col("arxiv_id").isNotNull() & (F.col("arxiv_id") != ""))


def topic_predicate(topic: Topic, title: Column, abstract: Column, categories: Column) -> Column:
    """Any include word, any category, no exclude word.

    `title` and `abstract` are lower case; words match as substrings of either.  A
    topic without any rule takes the default category scope.
    """

    def found(words: Sequence[str]) -> Column:
        cond = F.lit(False)
        for word in words:
            needle = F.lit(word.strip().lower())
            cond = cond | F.contains(title, needle) | F.contains(abstract, needle)
        return cond

    parts = []
    if topic.categories:
        parts.append(F.arrays_overlap(categories, F.array(*[F.lit(c) for c in topic.categories])))
    if topic.include:
        parts.append(found(topic.include))
    if topic.exclude:
        parts.append(~found(topic.exclude))
    if not parts:
        scope = DEFAULT_CATEGORY_SCOPE
        return F.exists(categories, lambda c: (c == scope) | c.startswith(scope + "."))
    cond = parts[0]
    for part in parts[1:]:
        cond = cond & part
    return F.coalesce(cond, F.lit(False))


def topic_candidates(papers: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """One row per paper and matching topic, with ``topic_idx``.

    Topics are configuration, so each becomes one predicate and a paper is matched
    where it is read: no join and no shuffle.
    """
    # lower-cased once per paper; the expressions below are used by every topic
    staged = papers.withColumn("_title", F.lower("title")).withColumn("_abstract", F.lower("abstract"))
    matched = F.array_compact(
        F.array(
            *[
                F.when(
                    topic_predicate(t, F.col("_title"), F.col("_abstract"), F.col("categories")), F.lit(i)
                )
                for i, t in enumerate(topics)
            ]
        )
    )
    return explode_rows(staged, matched, "topic_idx", papers.columns)


def with_topics(candidates: DataFrame, topics: Sequence[Topic]) -> DataFrame:
    """Attach the topic's names, words and interest text; the table is as long as the configuration."""
    table = topics_df(candidates.sparkSession, topics).withColumnRenamed("categories", "topic_categories")
    return candidates.join(F.broadcast(table), "topic_idx")


def recent(papers: DataFrame, run_ts: datetime, days_back: int) -> DataFrame:
    return papers.where(F.col("published") >= instant(run_ts) - F.expr(f"interval {int(days_back)} days"))


def in_window(papers: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends count."""
    return papers.where(F.col("published").between(instant(start), instant(end)))


def window_candidates(papers: DataFrame, start: datetime, end: datetime, chunk_days: int) -> DataFrame:
    """One row per paper and fetch window; a paper on a shared bound is in both.

    The outer range is a plain filter that reaches the scan.
    """
    ranged = in_window(papers, start, end)
    hits = windows_at(F.col("published"), start, end, chunk_days)
    return explode_rows(ranged, hits, "_w").select(*papers.columns, "_w.window_idx", "_w.win_start", "_w.win_end")


def single_window(candidates: DataFrame) -> DataFrame:
    """The weekly run has one window without bounds."""
    return candidates.withColumn("window_idx", F.lit(0))


def top_recent(candidates: DataFrame, cap: int | None) -> DataFrame:
    """Newest `cap` candidates per window and topic, with their ``rank``."""
    order = [F.col("published").desc(), F.col("arxiv_id").asc()]
    if cap is None:
        raise ValueError("rank all candidates with number_within instead of an unbounded cap")
    return top_per_group(candidates, ["window_idx", "topic_idx"], order, cap)


def fetch_one(papers: DataFrame, raw_id: str) -> DataFrame:
    """One paper by id, past topic and date rules."""
    wanted = typed_id(F.lit(raw_id))
    return papers.where(F.col("arxiv_id") == wanted).limit(1)
