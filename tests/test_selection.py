"""Candidates, ranking and selection against a row-at-a-time model."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.config import Dimension, Topic, TriageConfig
from paperloom.operators import candidates as C, intake, ranking, selection as S
from paperloom.plans import triage

SCHEMA = (
    "arxiv_id string, title string, abstract string, authors array<string>, affiliations array<string>, "
    "categories array<string>, published timestamp, updated timestamp, arxiv_url string, pdf_url string, comment string"
)
T0 = datetime(2024, 1, 1)


def papers(spark, rows):
    """Rows of (id, text, categories, day)."""
    data = [
        (i, t, t, ["A"], [], c, T0 + timedelta(days=d), T0 + timedelta(days=d), "u", None, None) for i, t, c, d in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


TOPICS = (Topic("t0", include=("alpha",)), Topic("t1", include=("beta", "gamma"), exclude=("bad",)), Topic("t2", "Two", ("c2",)))


def conf(**kw):
    base = {"topics": TOPICS, "max_per_topic": 50, "days_back": 400}
    return TriageConfig(**{**base, **kw})


def test_topic_rules(spark):
    rows = papers(
        spark,
        [
            ("a", "ALPHA x", ["c1"], 1),
            ("b", "alphabet beta", ["c2"], 1),
            ("c", "gamma bad", ["c1"], 1),
            ("d", "none", ["c2", "c3"], 1),
        ],
    )
    got = {tuple(r) for r in C.topic_candidates(rows, TOPICS).select("arxiv_id", "topic_idx").collect()}
    assert got == {("a", 0), ("b", 0), ("b", 1), ("b", 2), ("d", 2)}


def test_topic_without_rules_takes_default_scope(spark):
    rows = papers(spark, [("a", "x", ["cs.AI"], 1), ("b", "x", ["math.CO"], 1), ("c", "x", ["css"], 1)])
    got = C.topic_candidates(rows, (Topic("any"),)).collect()
    assert [r.arxiv_id for r in got] == ["a"]


def test_shared_window_bound_counts_twice(spark):
    rows = papers(spark, [("a", "alpha", [], 7), ("b", "alpha", [], 0), ("c", "alpha", [], 20)])
    got = C.window_candidates(rows, T0, T0 + timedelta(days=10), 7)
    assert sorted((r.arxiv_id, r.window_idx) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_top_per_group_equals_plain_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyyyy"), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = ranking.top_per_group(df, ["k"], [F.col("v").desc(), F.col("id")], 40)
    want = set()
    for key in "xy":
        best = sorted([r for r in rows if r[0] == key], key=lambda r: (-r[1], r[2]))[:40]
        want |= {(k, v, i, n) for n, (k, v, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_number_within_equals_plain_numbering(spark):
    rng = random.Random(4)
    rows = list({(rng.choice("pq"), rng.randrange(9), rng.random()) for _ in range(500)})
    df = spark.createDataFrame(rows, "k string, c int, v double")
    got = ranking.number_within(df, ["k"], "c", [F.col("v")], "n")
    want = set()
    for key in "pq":
        want |= {(*r, n) for n, r in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r.k, r.c, r.v, r.n) for r in got.collect()} == want


# --- the sequential rule: windows, then topics, seen once selected ---------------------


def sequential(rows, topics, passes, windows, limit, seen=()):
    seen, out = set(seen), []
    for w, (lo, hi) in enumerate(windows):
        for t, match in enumerate(topics):
            found = [r for r in rows if match(r) and lo <= r[3] <= hi]
            found.sort(key=lambda r: (-r[3], r[0]))
            found = [r for r in found if r[0] not in seen]
            if limit is not None:
                found = found[:limit]
            for r in found:
                if passes(t, r):
                    out.append((r[0], w, t))
                    seen.add(r[0])
    return sorted(out)


MATCH = (
    lambda r: "alpha" in r[1],
    lambda r: ("beta" in r[1] or "gamma" in r[1]) and "bad" not in r[1],
    lambda r: "c2" in r[2],
)
DIMS = (Dimension("methodology_fit", 1.0),)


def passes(t, r):
    words = TOPICS[t].include
    share = sum(w in r[1] for w in words) / len(words) if words else 0.5
    return share * 80 >= 60


def random_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "bad", "x", "y"]
    return [
        (f"p{i:03d}", " ".join(rng.sample(words, 3)), rng.sample(["c1", "c2"], 1), rng.randrange(21)) for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_first_topic_wins(spark, seed):
    rows = random_rows(seed)
    got = triage.select(papers(spark, rows), conf(dimensions=DIMS), T0 + timedelta(days=30))
    want = sequential(rows, MATCH, passes, [(0, 99)], None)
    assert sorted((r.arxiv_id, r.window_idx, r.topic_idx) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_first_window_wins_in_backfill(spark, seed):
    rows = random_rows(seed + 10)
    window = (T0, T0 + timedelta(days=20), 7)
    manifest = spark.createDataFrame([(r[0],) for r in rows[:9]], "arxiv_id string")
    got = triage.select(papers(spark, rows), conf(dimensions=DIMS), T0, manifest=manifest, window=window)
    want = sequential(rows, MATCH, passes, [(0, 7), (7, 14), (14, 20)], None, {r[0] for r in rows[:9]})
    assert sorted((r.arxiv_id, r.window_idx, r.topic_idx) for r in got.collect()) == want


@pytest.mark.parametrize("limit,seed", [(1, 21), (4, 21), (2, 22), (3, 23)])
def test_paper_limit_is_a_fold(spark, limit, seed):
    rows = random_rows(seed)
    window = (T0, T0 + timedelta(days=20), 10)
    got = triage.select(papers(spark, rows), conf(dimensions=DIMS, paper_limit=limit), T0, window=window)
    want = sequential(rows, MATCH, passes, [(0, 10), (10, 20)], limit)
    assert sorted((r.arxiv_id, r.window_idx, r.topic_idx) for r in got.collect()) == want


def test_fails_first_topic_passes_second(spark):
    rows = [("p", "alpha beta gamma", [], 1)]
    dims = (Dimension("topic_alignment", 1.0),)
    strict = (Topic("t0", include=("alpha", "q", "r")), Topic("t1", include=("beta", "gamma"), categories=()))
    got = triage.select(papers(spark, rows), conf(topics=strict, dimensions=dims), T0 + timedelta(days=2)).collect()
    assert [(r.arxiv_id, r.topic_idx) for r in got] == [("p", 1)]


def test_preview_counts_each_paper_once(spark):
    rows = papers(spark, [("a", "alpha beta", ["c2"], 1), ("b", "beta", [], 1)])
    got = S.preview(C.single_window(C.topic_candidates(rows, TOPICS))).collect()
    counts = {(r.window_idx, r.topic_idx): r.n for r in got}
    assert counts == {(0, 0): 1, (0, 1): 1, (0, None): 2, (None, None): 2}


def test_unknown_dimension_and_override(spark):
    rows = C.single_window(C.topic_candidates(papers(spark, [("a", "alpha", [], 1)]), TOPICS))
    dims = (Dimension("odd", 1.0), Dimension("mine", 1.0))
    got = S.score_candidates(rows, conf(dimensions=dims), {"mine": F.lit(250.0)}).first()
    assert [s.value for s in got.scores] == [0.5, 1.0]


def test_empty_topic_gets_placeholder(spark):
    rows = C.single_window(C.topic_candidates(papers(spark, [("a", "alpha", [], 1)]), TOPICS))
    got = {r.arxiv_id: r for r in S.fill_empty(rows, TOPICS, datetime(2024, 1, 1, 2, 3, 4)).collect()}
    assert set(got) == {"a", "demo-t1-020304", "demo-t2-020304"}
    assert got["demo-t2-020304"].categories == ["c2"]
    assert "beta, gamma" in got["demo-t1-020304"].abstract


def test_single_paper_is_scored_but_not_filtered(spark):
    rows = papers(spark, [("2401.00001", "nothing", [], 1)])
    got = triage.single_paper(rows, "2401.00001v3", "Two", conf()).collect()
    assert len(got) == 1 and got[0].topic == "t2" and got[0].score < 60
    assert triage.single_paper(rows, "2401.00001", "missing", conf()).first().topic == "t0"
    assert triage.single_paper(rows, "2401.00001", None, conf(topics=())).first().topic == "ad-hoc"


def test_resolve_topic(one):
    got = lambda name, topics=TOPICS: one(intake.resolve_topic(F.lit(name), topics))
    assert (got("t1"), got("Two"), got("nope"), got(None)) == (1, 2, 0, 0)
    assert got("x", ()) is None


def test_config_document():
    got = TriageConfig.from_dict(
        {
            "topics": [{"name": "some topic", "query": {"include": ["a"]}}],
            "relevance": {"scoring_dimensions": [{"name": "d", "weight": 1}]},
        }
    )
    assert got.topics[0].display == "Some Topic" and got.topics[0].categories == ()
    assert (got.pass_threshold, got.max_per_topic, got.days_back) == (60.0, 25, 7)
    assert got.dimensions == (Dimension("d", 1.0, ""),)


def test_limit_keeps_every_window_and_uses_replies(spark):
    rows = papers(spark, random_rows(22))
    window = (T0, T0 + timedelta(days=20), 5)
    best = '{"topic_alignment":{"score":100},"methodology_fit":{"score":100},"novelty":{"score":100},"experiment_completeness":{"score":100}}'
    replies = rows.select("arxiv_id", F.explode(F.sequence(F.lit(0), F.lit(len(TOPICS) - 1))).alias("topic_idx"), F.lit(best).alias("reply"))
    limited = triage.select(rows, conf(paper_limit=10_000), T0, window=window, replies=replies).collect()
    free = triage.select(rows, conf(), T0, window=window, replies=replies).collect()
    assert {r.window_idx for r in limited} == {r.window_idx for r in free} and len({r.window_idx for r in free}) > 1
    assert sorted(r.arxiv_id for r in limited) == sorted(r.arxiv_id for r in free)


def test_submissions_without_topics_are_scored(spark):
    rows = papers(spark, [("a", "alpha beta", ["c2"], 1)])
    asked = spark.createDataFrame([("s1", "2401.00001", None)], "sub_id string, raw string, topic string")
    none = spark.createDataFrame([], "arxiv_id string")
    found = triage.dispatched(asked, rows.withColumn("arxiv_id", F.lit("2401.00001")), none, [], conf(topics=()))
    assert [r.topic for r in found.collect()] == ["ad-hoc"]
