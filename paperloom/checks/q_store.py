"""What is written and read back: stores, snapshots, files with broken records, positions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import view
from paperloom.checks.q_state import CUT, HISTORY, NOTES, _history, _landed
from paperloom.checks.q_text import ENTRY
from paperloom.checks.q_views import INDEX, STATES, TAB_SQL, _marked, index
from paperloom.checks.registry import query
from paperloom.operators import analyses as A, state, views as V
from paperloom.session import shared_dir
from paperloom.sources import feed, records, sinks, store
from paperloom.streaming import feed as stream_feed, seen


@query(
    "store_round_trip",
    """
SELECT arxiv_id, score, generated_at, ver FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY ver DESC) AS rn
  FROM {analyses}) x WHERE rn = 1""",
)
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, a base, one run written once more, old versions deleted."""
    rows = view(spark, sf, "analyses").select("arxiv_id", "score", "generated_at", "ver")
    path = shared_dir(spark, "store")
    sinks.append(rows.where("ver = 0").withColumn("score", F.lit(-1.0)), path, tag="first")
    sinks.append(rows.where("ver = 0"), path, tag="first")
    sinks.compact(spark, path)
    sinks.append(rows.where("ver = 1"), path, tag="second")
    sinks.append(rows.where("ver = 1"), path, tag="second")
    store.forget(spark, path, keep=1)
    return sinks.current(spark, path)


@query(
    "stream_seen_keys",
    "SELECT arxiv_id, 1 AS n, 1 AS n_stored FROM (SELECT DISTINCT arxiv_id FROM {state_events}) x",
)
def stream_seen_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Many micro-batches in which keys come again, with runs of keys merged in between."""
    events = view(spark, sf, "state_events")
    out, ck = shared_dir(spark, "seen"), shared_dir(spark, "checkpoint")
    stream = _landed(events, spark, "event_id", 8, shuffled=True)
    done = stream_feed.run_incremental(
        stream, out, ck, "arxiv_id", ["ts", "event_id"], lambda new: new.select("arxiv_id", "op"), buckets=16, fan=3
    )
    stream_feed.run_until_done(done)
    kept = seen.stored(spark, f"{out}/keys", "arxiv_id").groupBy("arxiv_id").agg(F.count("*").cast("int").alias("n_stored"))
    rows = stream_feed.read_rows(spark, out).groupBy("arxiv_id").agg(F.count("*").cast("int").alias("n"))
    return rows.join(kept, "arxiv_id", "full_outer")


def _before(states: str) -> str:
    """The same state from the events before yesterday's snapshot, under other names."""
    for name in ("sev", "slast", "stars", "hidden"):
        states = states.replace(f"{name} AS (", f"old_{name} AS (").replace(f"FROM {name} ", f"FROM old_{name} ")
    states = states.replace("JOIN slast l", "JOIN old_slast l")
    return states.replace("{state_events}", f"(SELECT * FROM {{state_events}} WHERE ts < {CUT}) ev")


@query(
    "archive_snapshots",
    f"""
WITH {STATES}, {_before(STATES)}, {HISTORY},
old_hist AS (SELECT * FROM {{chat_turns}} WHERE seq < 4 AND role IN ('user', 'assistant') AND (role = 'user' OR content <> ''))
SELECT 'stars' AS kind, coalesce(n.arxiv_id, o.arxiv_id) AS key, CASE WHEN n.arxiv_id IS NULL THEN 'removed'
  WHEN o.arxiv_id IS NULL THEN 'added' ELSE 'changed' END AS op FROM stars n FULL JOIN old_stars o ON n.arxiv_id = o.arxiv_id
WHERE n.arxiv_id IS NULL OR o.arxiv_id IS NULL OR n.starred_at <> o.starred_at OR n.topic IS DISTINCT FROM o.topic OR n.note IS DISTINCT FROM o.note
UNION ALL
SELECT 'hidden', coalesce(n.arxiv_id, o.arxiv_id), CASE WHEN n.arxiv_id IS NULL THEN 'removed'
  WHEN o.arxiv_id IS NULL THEN 'added' ELSE 'changed' END FROM hidden n FULL JOIN old_hidden o ON n.arxiv_id = o.arxiv_id
WHERE n.arxiv_id IS NULL OR o.arxiv_id IS NULL OR n.hidden_at <> o.hidden_at
UNION ALL
SELECT 'chats', coalesce(n.arxiv_id, o.arxiv_id) || ' ' || coalesce(n.seq, o.seq), CASE WHEN n.arxiv_id IS NULL THEN 'removed'
  ELSE 'added' END FROM hist n FULL JOIN old_hist o ON n.arxiv_id = o.arxiv_id AND n.seq = o.seq
WHERE n.arxiv_id IS NULL OR o.arxiv_id IS NULL""",
)
def archive_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of stars, hides and chat turns; what the second wrote, removals included."""
    events, path = view(spark, sf, "state_events"), shared_dir(spark, "archive")
    before = events.where(f"ts < {CUT}")
    turns, said = view(spark, sf, "chat_turns"), _history(spark, sf)
    early = turns.where("seq < 4 AND role IN ('user', 'assistant') AND (role = 'user' OR content <> '')")
    keep = ("arxiv_id", "starred_at", "topic", "note")
    kinds = {
        "stars": (state.star_state(before).select(*keep), state.star_state(events).select(*keep), ["arxiv_id"]),
        "hidden": (state.hide_state(before), state.hide_state(events), ["arxiv_id"]),
        "chats": (early, said.where("role IN ('user', 'assistant') AND (role = 'user' OR content <> '')"), ["arxiv_id", "seq"]),
    }
    found = None
    for kind, (old, new, keys) in kinds.items():
        sinks.write_snapshot(old, path, keys, kind)
        sinks.write_snapshot(new, path, keys, kind)
        rows = spark.read.schema("arxiv_id string, seq bigint, op string").json(f"{path}/{kind}/changes/1")
        rows = rows.select(F.lit(kind).alias("kind"), F.concat_ws(" ", *keys).alias("key"), "op")
        found = rows if found is None else found.union(rows)
    return found


# every tenth entry is no XML, every tenth has no id
_BAD = "CASE doc_id % 10 WHEN 3 THEN 'broken' WHEN 7 THEN 'nameless' ELSE 'fine' END"


@query(
    "feed_files",
    f"""
SELECT arxiv_id, 'paper' AS kind, 1 AS n, published || ' 00' AS published FROM {{papers}} WHERE {_BAD} = 'fine'
UNION ALL SELECT NULL, CASE {_BAD} WHEN 'broken' THEN 'broken entry' ELSE 'no id' END, count(*), NULL FROM {{papers}}
WHERE {_BAD} <> 'fine' GROUP BY {_BAD}""",
)
def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Feed files in which some entries are broken: the others are read, these are reported."""
    safe = {c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')" for c in ("title", "abstract")}
    entry = ENTRY.format(**safe)
    spoilt = (
        f"CASE {_BAD} WHEN 'broken' THEN replace({entry}, '</title>', '</titel>') "
        f"WHEN 'nameless' THEN regexp_replace({entry}, '<id>[^<]*</id>', '') ELSE {entry} END"
    )
    path = shared_dir(spark, "feed")
    view(spark, sf, "papers").select(F.expr(spoilt).alias("value")).write.text(path)
    read = feed.read_feed(spark, path, datetime(2024, 2, 20)).select(
        "arxiv_id", F.lit("paper").alias("kind"), F.lit(1).cast("bigint").alias("n"),
        F.date_format("published", "yyyy-MM-dd HH").alias("published"),
    )
    refused = feed.rejected_entries(spark, path).groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n"))
    return read.unionByName(refused, allowMissingColumns=True)


@query(
    "record_files",
    f"""
SELECT arxiv_id, title, 'record' AS kind, 1 AS n FROM {{papers}} WHERE {_BAD} = 'fine'
UNION ALL SELECT NULL, NULL, CASE {_BAD} WHEN 'broken' THEN 'no JSON' ELSE 'no arxiv_id' END, count(*) FROM {{papers}}
WHERE {_BAD} <> 'fine' GROUP BY {_BAD}""",
)
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    whole = "to_json(struct(arxiv_id, title, abstract))"
    doc = f"CASE {_BAD} WHEN 'broken' THEN rtrim('}}', {whole}) WHEN 'nameless' THEN to_json(struct(title, abstract)) ELSE {whole} END"
    path = shared_dir(spark, "records")
    view(spark, sf, "papers").select(F.expr(doc).alias("value")).write.text(path)
    read = records.read_analyses(spark, path, lines=True).where("coalesce(arxiv_id, '') <> ''")
    rows = read.select("arxiv_id", F.col("title.en").alias("title"), F.lit("record").alias("kind"), F.lit(1).cast("bigint").alias("n"))
    refused = records.rejected_analyses(spark, path, lines=True).groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n"))
    return rows.unionByName(refused, allowMissingColumns=True)


@query("page_files", "SELECT page_id, url, html FROM {pages}")
def page_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "pages")
    view(spark, sf, "pages").select("page_id", "url", "html").write.json(path)
    return records.read_pages(spark, path, "json").withColumn("page_id", F.col("page_id").cast("bigint"))


@query(
    "index_positions",
    f"WITH {INDEX} SELECT arxiv_id, row_number() OVER (ORDER BY coalesce(generated_at, '') DESC, arxiv_id DESC) - 1 AS position FROM ix",
)
def index_positions(spark: SparkSession, sf: str) -> DataFrame:
    return A.index_positions(index(spark, sf)).select("arxiv_id", "position")


@query(
    "facet_positions",
    f"""
WITH {STATES}, {INDEX}, f AS (SELECT topic, arg_max(coalesce(nullif(topic_label, ''), topic), (generated_at, arxiv_id)) AS label,
  count(*) AS n FROM ix WHERE {TAB_SQL['all']} GROUP BY topic)
SELECT *, row_number() OVER (ORDER BY lower(label), topic) - 1 AS position FROM f""",
)
def facet_positions(spark: SparkSession, sf: str) -> DataFrame:
    return V.facet_positions(V.in_tab(_marked(spark, sf), "all"))


@query(
    "note_positions",
    f"WITH {NOTES} SELECT arxiv_id, note_id, row_number() OVER (ORDER BY created_at DESC, arxiv_id, note_id) - 1 AS position FROM notes",
)
def note_positions(spark: SparkSession, sf: str) -> DataFrame:
    notes = state.annotation_state(view(spark, sf, "note_events"))
    return state.note_positions(notes).select("arxiv_id", "note_id", "position")
