"""Matching, ranking, scoring, selection, intake."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import BACKFILL, CONF, RUN_TS, TOPICS, papers, view
from paperloom.checks.registry import query
from paperloom.config import TriageConfig
from paperloom.functions import dates, ids
from paperloom.operators import candidates as C, intake, selection as S
from paperloom.plans import triage


def _with(**changes) -> TriageConfig:
    return TriageConfig(**{**CONF.__dict__, **changes})


def _cands(spark: SparkSession, sf: str) -> DataFrame:
    return C.single_window(C.topic_candidates(C.with_id(papers(spark, sf)), TOPICS))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_candidates(_cands(spark, sf), CONF)


@query("topic_candidates", "SELECT arxiv_id, topic_idx, published FROM {cand}")
def topic_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _cands(spark, sf).select("arxiv_id", "topic_idx", dates.day(F.col("published")).alias("published"))


@query("recent_candidates", "SELECT arxiv_id, published FROM {papers} WHERE published >= '2024-01-13'")
def recent_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.recent(papers(spark, sf), datetime(2024, 1, 20), 7)
    return rows.select("arxiv_id", dates.day(F.col("published")).alias("published"))


WINDOWS = """(SELECT i AS window_idx, DATE '2024-01-01' + 7 * i AS win_start,
  least(DATE '2024-01-01' + 7 * i + 7, DATE '2024-01-31') AS win_end FROM (VALUES (0), (1), (2), (3), (4)) AS w(i))"""


@query(
    "window_candidates",
    f"""
SELECT p.arxiv_id, w.window_idx, strftime(w.win_start, '%Y%m%d0000') AS win_start, strftime(w.win_end, '%Y%m%d0000') AS win_end
FROM {{papers}} p JOIN {WINDOWS} w ON CAST(p.published AS DATE) BETWEEN w.win_start AND w.win_end""",
)
def window_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.window_candidates(papers(spark, sf), *BACKFILL)
    return rows.select(
        "arxiv_id",
        "window_idx",
        dates.compact(F.col("win_start")).alias("win_start"),
        dates.compact(F.col("win_end")).alias("win_end"),
    )


@query(
    "top_recent_per_topic",
    """
SELECT window_idx, topic_idx, rank, arxiv_id FROM (SELECT *, row_number() OVER (PARTITION BY window_idx, topic_idx
  ORDER BY published DESC, arxiv_id) AS rank FROM {cand}) x WHERE rank <= 25""",
)
def top_recent_per_topic(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_recent(_cands(spark, sf), 25).select(
        "window_idx", "topic_idx", F.col("rank").cast("bigint").alias("rank"), "arxiv_id"
    )


@query(
    "backfill_candidates",
    f"""
SELECT window_idx, topic_idx, arxiv_id FROM (
  SELECT w.window_idx, c.topic_idx, c.arxiv_id,
    row_number() OVER (PARTITION BY w.window_idx, c.topic_idx ORDER BY c.published DESC, c.arxiv_id) AS rank
  FROM {{cand}} c JOIN {WINDOWS} w ON CAST(c.published AS DATE) BETWEEN w.win_start AND w.win_end) x WHERE rank <= 10""",
)
def backfill_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.candidates(papers(spark, sf), _with(max_per_topic=10), RUN_TS, BACKFILL)
    return rows.select("window_idx", "topic_idx", "arxiv_id")


@query(
    "offline_scores",
    """
SELECT arxiv_id, topic_idx, d.name, d.value FROM (SELECT arxiv_id, topic_idx, unnest([
  {'name': 'topic_alignment', 'value': d0}, {'name': 'methodology_fit', 'value': d1},
  {'name': 'novelty', 'value': d2}, {'name': 'experiment_coverage', 'value': d3}]) AS d FROM {dims}) x""",
)
def offline_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).select("arxiv_id", "topic_idx", F.explode("scores").alias("d"))
    return rows.select("arxiv_id", "topic_idx", "d.name", "d.value")


@query("normalised_scores", "SELECT arxiv_id, topic_idx, total_score, score FROM {scored}")
def normalised_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("arxiv_id", "topic_idx", "total_score", "score")


@query("selected_papers", "SELECT arxiv_id, topic, topic_label, title, score, published FROM {selected}")
def selected_papers(spark: SparkSession, sf: str) -> DataFrame:
    return S.index_rows(triage.select(papers(spark, sf), CONF, RUN_TS))


@query(
    "backfill_selection",
    f"""
SELECT arxiv_id, window_idx, topic, score FROM (
  SELECT s.arxiv_id, w.window_idx, s.topic, s.score,
    row_number() OVER (PARTITION BY s.arxiv_id ORDER BY w.window_idx, s.topic_idx) AS rn
  FROM (SELECT w.window_idx, c.*, row_number() OVER (PARTITION BY w.window_idx, c.topic_idx
      ORDER BY c.published DESC, c.arxiv_id) AS rank
    FROM {{scored}} c JOIN {WINDOWS} w ON CAST(c.published AS DATE) BETWEEN w.win_start AND w.win_end) s
  JOIN {WINDOWS} w ON w.window_idx = s.window_idx
  WHERE s.rank <= 20 AND s.score >= 60 AND s.arxiv_id NOT IN (SELECT arxiv_id FROM {{manifest}})) x WHERE rn = 1""",
)
def backfill_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = triage.select(
        papers(spark, sf), _with(max_per_topic=20), RUN_TS, manifest=view(spark, sf, "manifest"), window=BACKFILL
    )
    return chosen.select("arxiv_id", "window_idx", "topic", "score")


@query(
    "unseen_candidates",
    "SELECT arxiv_id, topic_idx FROM {cand} WHERE arxiv_id NOT IN (SELECT arxiv_id FROM {manifest})",
)
def unseen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return S.unseen(_cands(spark, sf), view(spark, sf, "manifest")).select("arxiv_id", "topic_idx")


@query(
    "seen_ids",
    "SELECT arxiv_id FROM {manifest} UNION SELECT arxiv_id FROM {selected}",
)
def seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    return S.seen_ids(view(spark, sf, "manifest"), triage.select(papers(spark, sf), CONF, RUN_TS))


@query(
    "dedup_report",
    """
SELECT topic_idx, count(*) AS before, count(*) FILTER (WHERE arxiv_id NOT IN (SELECT arxiv_id FROM {manifest})) AS after
FROM {cand} GROUP BY topic_idx""",
)
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    return S.dedup_counts(_cands(spark, sf), view(spark, sf, "manifest"))


def _limit_sql(limit: int) -> str:
    """Topics one after the other, each on what the earlier ones left."""
    ctes, taken = [], []
    for i in range(len(TOPICS)):
        gone = " UNION ALL ".join(f"SELECT arxiv_id FROM s{j}" for j in range(i)) or "SELECT '' AS arxiv_id"
        ctes.append(
            f"s{i} AS (SELECT * FROM (SELECT * FROM {{scored}} WHERE topic_idx = {i} AND arxiv_id NOT IN ({gone}) "
            f"ORDER BY published DESC, arxiv_id LIMIT {limit}) x WHERE score >= 60)"
        )
        taken.append(f"SELECT arxiv_id, topic, score FROM s{i}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(taken)


@query("paper_limit_selection", _limit_sql(15))
def paper_limit_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = triage.select(papers(spark, sf), _with(paper_limit=15), RUN_TS)
    return chosen.select("arxiv_id", "topic", "score")


@query(
    "dry_run_preview",
    f"""
SELECT window_idx, topic_idx, count(*) AS n FROM (
  SELECT c.arxiv_id, w.window_idx, c.topic_idx,
    row_number() OVER (PARTITION BY c.arxiv_id ORDER BY w.window_idx, c.topic_idx) AS rn
  FROM {{cand}} c JOIN {WINDOWS} w ON CAST(c.published AS DATE) BETWEEN w.win_start AND w.win_end
  WHERE c.arxiv_id NOT IN (SELECT arxiv_id FROM {{manifest}})) x
WHERE rn = 1 GROUP BY ROLLUP (window_idx, topic_idx)""",
)
def dry_run_preview(spark: SparkSession, sf: str) -> DataFrame:
    found = triage.candidates(papers(spark, sf), CONF, RUN_TS, BACKFILL)
    return S.preview(S.unseen(found, view(spark, sf, "manifest")))


@query(
    "run_stats",
    """
SELECT CAST(4 AS BIGINT) AS topics_processed, count(*) AS papers_fetched,
  count(DISTINCT arxiv_id) FILTER (WHERE score >= 60) AS papers_selected FROM {scored}""",
)
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_stats(_scored(spark, sf), len(TOPICS), CONF.pass_threshold)


@query(
    "empty_topic_filler",
    """
SELECT topic_idx, arxiv_id, title, abstract FROM {cand}
UNION ALL
SELECT topic_idx, concat('demo-', topic, '-060000'), concat('[Demo] ', topic_label, ' Automated Test Example'),
  concat('Placeholder record that lets a run go through without input. Topic: ', topic_label, '. Keywords: ',
    CASE WHEN include = '' THEN topic_label ELSE replace(include, '|', ', ') END, '. Categories: ',
    CASE WHEN categories = '' THEN 'cs.AI' ELSE replace(categories, '|', ', ') END, '.')
FROM {topics} WHERE topic_idx NOT IN (SELECT topic_idx FROM {cand})""",
)
def empty_topic_filler(spark: SparkSession, sf: str) -> DataFrame:
    filled = S.fill_empty(_cands(spark, sf).drop("doc_id"), TOPICS, RUN_TS)
    return filled.select("topic_idx", "arxiv_id", "title", "abstract")


@query(
    "id_canonical",
    r"""
SELECT sub_id, string_split(list_last(string_split(raw, '/')), 'v')[1] AS feed_id,
  regexp_replace(trim(raw), 'v[0-9]+$', '') AS typed_id,
  coalesce(nullif(regexp_extract(raw, '(\d{4}\.\d{4,5})(v\d+)?', 1), ''),
    nullif(regexp_extract(raw, '([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?', 1), '')) AS found_id
FROM {submissions}""",
)
def id_canonical(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return view(spark, sf, "submissions").select(
        "sub_id",
        ids.feed_id(raw).alias("feed_id"),
        ids.typed_id(raw).alias("typed_id"),
        ids.find_id(raw).alias("found_id"),
    )


@query(
    "fetch_one",
    "SELECT arxiv_id, title FROM {papers} WHERE arxiv_id = '1000.00007'",
)
def fetch_one(spark: SparkSession, sf: str) -> DataFrame:
    return C.fetch_one(papers(spark, sf), " 1000.00007v3 ").select("arxiv_id", "title")


@query(
    "ingest_triage",
    r"""
WITH f AS (SELECT sub_id, topic, coalesce(nullif(regexp_extract(raw, '(\d{4}\.\d{4,5})(v\d+)?', 1), ''),
    nullif(regexp_extract(raw, '([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?', 1), '')) AS arxiv_id FROM {submissions})
SELECT sub_id, arxiv_id, CASE WHEN arxiv_id IS NULL THEN 'invalid'
  WHEN arxiv_id IN (SELECT arxiv_id FROM {manifest}) THEN 'already_analysed' ELSE 'dispatched' END AS status,
  CASE topic WHEN 'prose_fr' THEN 1 WHEN 'Mixed prose' THEN 2 ELSE 0 END AS topic_idx FROM f""",
)
def ingest_triage(spark: SparkSession, sf: str) -> DataFrame:
    done = intake.triage(view(spark, sf, "submissions"), view(spark, sf, "manifest"))
    return done.select(
        "sub_id", "arxiv_id", "status", intake.resolve_topic(F.col("topic"), TOPICS).alias("topic_idx")
    )


@query(
    "dispatched_scores",
    r"""
WITH f AS (SELECT sub_id, topic, nullif(regexp_extract(raw, '(\d{4}\.\d{4,5})(v\d+)?', 1), '') AS arxiv_id
  FROM {submissions}),
d AS (SELECT arxiv_id, CASE topic WHEN 'prose_fr' THEN 1 WHEN 'Mixed prose' THEN 2 ELSE 0 END AS topic_idx FROM f
  WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM {manifest})),
x AS (SELECT d.arxiv_id, t.topic, lower(concat(p.title, ' ', p.abstract)) AS txt, t.* EXCLUDE (topic)
  FROM d JOIN {papers} p ON p.arxiv_id = d.arxiv_id JOIN {topics} t ON t.topic_idx = d.topic_idx)
SELECT arxiv_id, topic,
  len(list_filter(string_split(include, '|'), lambda k: contains(txt, k)))::DOUBLE / len(string_split(include, '|')) * 70.0::DOUBLE
   + len(list_filter(string_split(categories, '|'), lambda k: contains(txt, k)))::DOUBLE / len(string_split(categories, '|')) * 30.0::DOUBLE
   AS alignment FROM x""",
)
def dispatched_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = triage.dispatched(
        view(spark, sf, "submissions"), papers(spark, sf), view(spark, sf, "manifest"), list(TOPICS), CONF
    )
    return rows.select("arxiv_id", "topic", (F.col("scores")[0]["value"] * 100.0).alias("alignment"))

