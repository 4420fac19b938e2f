"""User state, chats, archive, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.checks.inputs import table, view
from paperloom.checks.q_views import STATES, analyses
from paperloom.checks.registry import query
from paperloom.operators import analyses as A, archive, candidates, chats, prompts, state
from paperloom.session import shared_dir
from paperloom.sources import records, sinks
from paperloom.streaming import feed as stream_feed, state as stream_state

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text(col: str) -> "F.Column":
    return F.date_format(col, TS).alias(col)


@query(
    "star_state",
    f"WITH {STATES} SELECT arxiv_id, strftime(starred_at, '%Y-%m-%d %H:%M:%S.%f') AS starred_at, topic, note FROM stars",
)
def star_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.star_state(view(spark, sf, "state_events")).select("arxiv_id", _text("starred_at"), "topic", "note")


@query(
    "hide_state",
    f"WITH {STATES} SELECT arxiv_id, strftime(hidden_at, '%Y-%m-%d %H:%M:%S.%f') AS hidden_at FROM hidden",
)
def hide_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.hide_state(view(spark, sf, "state_events")).select("arxiv_id", _text("hidden_at"))


@query(
    "state_counts",
    f"WITH {STATES} SELECT 'hidden' AS kind, count(*) AS n FROM hidden UNION ALL SELECT 'stars', count(*) FROM stars",
)
def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_events")
    stars = state.state_list(state.star_state(events)).withColumn("kind", F.lit("stars"))
    return stars.unionByName(state.state_list(state.hide_state(events)).withColumn("kind", F.lit("hidden")))


NOTES = """
ok AS (SELECT *, trim(quote, ' ' || chr(9) || chr(10) || chr(13)) AS q, trim(note) AS n FROM {note_events}
  WHERE op = 'delete' OR (stage <> 'bad' AND trim(quote, ' ' || chr(9) || chr(10) || chr(13)) <> '')),
lives AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY arxiv_id, note_id ORDER BY ts, event_id) AS life FROM ok),
last AS (SELECT arxiv_id, note_id, max(life) AS life FROM lives GROUP BY arxiv_id, note_id),
notes AS (SELECT l.arxiv_id, l.note_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(stage, (ts, event_id)) AS stage,
  arg_max(q, (ts, event_id)) AS quote, arg_max(n, (ts, event_id)) AS note FROM lives l JOIN last ON l.arxiv_id = last.arxiv_id
  AND l.note_id = last.note_id AND l.life = last.life WHERE op = 'upsert' GROUP BY l.arxiv_id, l.note_id)"""


@query(
    "annotation_state",
    f"""
WITH {NOTES} SELECT arxiv_id, note_id, stage, quote, note, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM notes""",
)
def annotation_state(spark: SparkSession, sf: str) -> DataFrame:
    notes = state.newest_notes(state.annotation_state(view(spark, sf, "note_events")))
    return notes.select("arxiv_id", "note_id", "stage", "quote", "note", _text("created_at"), _text("updated_at"))


@query(
    "annotation_rejects",
    """
SELECT event_id, CASE WHEN stage = 'bad' THEN 'invalid stage' ELSE 'quote required' END AS reason FROM {note_events}
WHERE op = 'upsert' AND (stage = 'bad' OR trim(quote, ' ' || chr(9) || chr(10) || chr(13)) = '')""",
)
def annotation_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return state.rejected_notes(view(spark, sf, "note_events")).select("event_id", "reason")


@query(
    "annotation_anchor",
    f"""
WITH {NOTES}, s AS (SELECT arxiv_id, CASE stage WHEN 'brief' THEN abstract WHEN 'relevance' THEN nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END, '')
   WHEN 'qa' THEN CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'why?' || chr(10) || lang END
   ELSE CASE WHEN doc_id % 3 = 0 THEN NULL WHEN (doc_id + i) % 2 = 0 THEN source ELSE ' ' END END AS section, stage
  FROM {{latest}}, (VALUES ('relevance', 0), ('brief', 0), ('problem', 0), ('solution', 1), ('methodology', 2), ('experiments', 3),
    ('conclusion', 4), ('qa', 0)) AS t(stage, i))
SELECT n.arxiv_id, n.note_id, CASE WHEN instr(coalesce(section, ''), quote) > 0 THEN instr(section, quote) - 1 END AS position,
  instr(coalesce(section, ''), quote) = 0 AS orphan
FROM notes n LEFT JOIN s ON s.arxiv_id = n.arxiv_id AND s.stage = n.stage""",
)
def annotation_anchor(spark: SparkSession, sf: str) -> DataFrame:
    notes = state.annotation_state(view(spark, sf, "note_events"))
    found = state.anchor(notes, A.sections(A.latest(analyses(spark, sf))))
    return found.select("arxiv_id", "note_id", F.col("position").cast("bigint").alias("position"), "orphan")


@query(
    "state_file_rows",
    f"WITH {STATES} SELECT arxiv_id, topic, note FROM stars",
)
def state_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    # one map-shaped document per star, as a state file holds them
    stars = state.star_state(view(spark, sf, "state_events"))
    entry = F.struct("topic", "note", F.col("starred_at").cast("string").alias("starred_at"))
    docs = stars.select(F.to_json(F.struct(F.create_map("arxiv_id", entry).alias("stars"))).alias("json"))
    return records.explode_stars(docs).select("arxiv_id", "topic", "note")


# --- chats ------------------------------------------------------------------------------

# a clear event after every turn of an odd conversation that says nothing
CLEARS = "SELECT arxiv_id, max(seq) AS seq FROM {chat_turns} WHERE role = 'system' GROUP BY arxiv_id"
HISTORY = f"""
cl AS ({CLEARS}), hist AS (SELECT t.* FROM {{chat_turns}} t LEFT JOIN cl ON cl.arxiv_id = t.arxiv_id
  WHERE role IN ('user', 'assistant') AND (role = 'user' OR content <> '') AND (cl.seq IS NULL OR t.seq > cl.seq))"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    turns = view(spark, sf, "chat_turns")
    return chats.after_last_clear(turns, turns.where("role = 'system'").select("arxiv_id", "seq"))


@query("chat_history", f"WITH {HISTORY} SELECT arxiv_id, seq, role, content FROM hist")
def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    return chats.turn_messages(_history(spark, sf))


@query(
    "chat_snapshot",
    f"""
WITH {HISTORY} SELECT arxiv_id, seq // 500 AS part, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS text
FROM hist GROUP BY arxiv_id, seq // 500""",
)
def chat_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    parts = chats.chat_snapshot(_history(spark, sf))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return parts.select("arxiv_id", "part", "n", text.alias("text"))


@query(
    "chat_messages",
    f"""
WITH {HISTORY}, asked AS (SELECT DISTINCT arxiv_id FROM {{chat_turns}})
SELECT arxiv_id, seq, role, content FROM hist
UNION ALL SELECT arxiv_id, 4611686018427387904, 'user', 'and then?' FROM asked
UNION ALL SELECT arxiv_id, -1, 'system', 'about ' || title FROM {{papers}} WHERE arxiv_id IN (SELECT arxiv_id FROM asked)""",
)
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    asked = view(spark, sf, "chat_turns").select("arxiv_id").distinct().withColumn("message", F.lit("and then?"))
    contexts = view(spark, sf, "papers").select("arxiv_id", F.concat(F.lit("about "), "title").alias("system"))
    return prompts.chat_messages(contexts, _history(spark, sf), asked)


# --- archive ----------------------------------------------------------------------------

# yesterday's snapshot is the state without the last day of events
CUT = "TIMESTAMP '2024-01-05 00:00:00'"


@query(
    "archive_changes",
    f"""
WITH hid AS (SELECT arxiv_id, max(ts) AS hidden_at FROM {{state_events}} WHERE op IN ('hide', 'unhide') GROUP BY arxiv_id
  HAVING arg_max(op, (ts, event_id)) = 'hide'),
old AS (SELECT arxiv_id, max(ts) AS hidden_at FROM {{state_events}} WHERE op IN ('hide', 'unhide') AND ts < {CUT} GROUP BY arxiv_id
  HAVING arg_max(op, (ts, event_id)) = 'hide')
SELECT 'hidden' AS kind, count(*) AS checked, count(*) FILTER (WHERE old.hidden_at IS DISTINCT FROM hid.hidden_at) AS committed, true AS ok
FROM hid LEFT JOIN old ON old.arxiv_id = hid.arxiv_id""",
)
def archive_changes(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_events")
    now = state.hide_state(events).withColumn("updated_at", F.lit("today"))
    before = state.hide_state(events.where(f"ts < {CUT}")).withColumn("updated_at", F.lit("yesterday"))
    compared = archive.compare(now, before, ["arxiv_id"]).withColumn("kind", F.lit("hidden"))
    return archive.snapshot_summary(compared)


@query(
    "archive_new_rows",
    f"""
WITH hid AS (SELECT arxiv_id, max(ts) AS hidden_at FROM {{state_events}} WHERE op IN ('hide', 'unhide') GROUP BY arxiv_id
  HAVING arg_max(op, (ts, event_id)) = 'hide'),
old AS (SELECT arxiv_id, max(ts) AS hidden_at FROM {{state_events}} WHERE op IN ('hide', 'unhide') AND ts < {CUT} GROUP BY arxiv_id
  HAVING arg_max(op, (ts, event_id)) = 'hide')
SELECT hid.arxiv_id FROM hid LEFT JOIN old ON old.arxiv_id = hid.arxiv_id WHERE old.hidden_at IS DISTINCT FROM hid.hidden_at""",
)
def archive_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_events")
    before = state.hide_state(events.where(f"ts < {CUT}"))
    return archive.changed_only(state.hide_state(events), before, ["arxiv_id"]).select("arxiv_id")


# --- streams ----------------------------------------------------------------------------


def _range_of(df: DataFrame, by: str, ranges: int) -> "F.Column":
    """Number of a row's range of `by`.  The bounds are read from that column alone, not from whole rows."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = (df.agg(F.percentile_approx(by, shares, 10_000)).first()[0] or []) if shares else []
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(by))), F.lit(0)) if bounds else F.lit(0)


def _landed(df: DataFrame, spark: SparkSession, by: str, batches: int, shuffled: bool = False, copies: int = 1) -> DataFrame:
    """The rows as a stream of about `batches` micro-batches, landed by one distributed write.

    Each file holds a range of `by`, or with `shuffled` rows from everywhere, so that
    every micro-batch brings late events.  Every row lands `copies` times, in the same file.
    """
    path = shared_dir(spark, "landing")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartition(files, F.xxhash64(by)) if shuffled else df.repartitionById(files, _range_of(df, by, files))
    if copies > 1:  # rows move once
        dealt = dealt.withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(copies)]))).select(df.columns)
    dealt.write.parquet(path)
    return stream_feed.file_stream(spark, path, df.schema, -(-files // batches))


@query(
    "stream_dedup",
    "SELECT arxiv_id, count(*) AS n FROM (SELECT DISTINCT arxiv_id FROM {state_events}) x GROUP BY arxiv_id",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "state_events")
    out, ck = shared_dir(spark, "incremental"), shared_dir(spark, "checkpoint")
    stream = _landed(events, spark, "event_id", 4)
    query_ = stream_feed.run_incremental(
        stream, out, ck, "arxiv_id", ["ts", "event_id"], lambda new: new.select("arxiv_id", "op")
    )
    stream_feed.run_until_done(query_)
    return stream_feed.read_rows(spark, out).groupBy("arxiv_id").agg(F.count("*").alias("n"))


@query(
    "stream_candidates",
    "SELECT arxiv_id, topic_idx FROM {cand}",
)
def stream_candidates(spark: SparkSession, sf: str) -> DataFrame:
    from paperloom.checks.inputs import TOPICS, papers

    feed = papers(spark, sf)
    out, ck = shared_dir(spark, "incremental"), shared_dir(spark, "checkpoint")
    # everything arrives twice; the second copy must not be handled again
    stream = _landed(feed, spark, "doc_id", 4, copies=2)
    read = ["arxiv_id", "title", "abstract", "categories", "published"]  # what matching and the order need
    query_ = stream_feed.run_incremental(
        stream.select(read), out, ck, "arxiv_id", ["published"],
        lambda new: candidates.topic_candidates(new, TOPICS).select("arxiv_id", "topic_idx"),
    )
    stream_feed.run_until_done(query_)
    return stream_feed.read_rows(spark, out)


_STREAM_STARS = (
    f"WITH {STATES} SELECT arxiv_id, strftime(starred_at, '%Y-%m-%d %H:%M:%S.%f') AS starred_at, topic, note FROM stars"
)


@query("stream_state", _STREAM_STARS)
def stream_star_state(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    events = view(spark, sf, "state_events")
    out, ck = shared_dir(spark, "stars"), shared_dir(spark, "checkpoint")
    stream = _landed(events, spark, "ts", 4, shuffled)
    stream_feed.run_until_done(stream_state.run_star_stream(stream, out, ck))
    return stream_state.star_state(spark, out).select("arxiv_id", _text("starred_at"), "topic", "note")


_STREAM_HIDES = (
    f"WITH {STATES} SELECT arxiv_id, strftime(hidden_at, '%Y-%m-%d %H:%M:%S.%f') AS hidden_at FROM hidden"
)


@query("stream_hides", _STREAM_HIDES)
def stream_hides(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    events = view(spark, sf, "state_events")
    out, ck = shared_dir(spark, "hides"), shared_dir(spark, "checkpoint")
    stream = _landed(events, spark, "ts", 3, shuffled)
    stream_feed.run_until_done(stream_state.run_hide_stream(stream, out, ck))
    return stream_state.hide_state(spark, out).select("arxiv_id", _text("hidden_at"))


_STREAM_NOTES = (
    f"WITH {NOTES} SELECT arxiv_id, note_id, stage, quote, note, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM notes"
)


@query("stream_annotations", _STREAM_NOTES)
def stream_annotations(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    events = view(spark, sf, "note_events")
    out, ck = shared_dir(spark, "notes"), shared_dir(spark, "checkpoint")
    stream = _landed(events, spark, "ts", 3, shuffled)
    stream_feed.run_until_done(stream_state.run_note_stream(stream, out, ck))
    return stream_state.annotation_state(spark, out).select(
        "arxiv_id", "note_id", "stage", "quote", "note", _text("created_at")
    )


@query("stream_chats", f"WITH {HISTORY} SELECT arxiv_id, seq, role, content FROM hist")
def stream_chats(spark: SparkSession, sf: str) -> DataFrame:
    turns = view(spark, sf, "chat_turns").withColumn("role", F.regexp_replace("role", "^system$", "clear"))
    out, ck = shared_dir(spark, "chats"), shared_dir(spark, "checkpoint")
    stream = _landed(turns, spark, "seq", 2)
    stream_feed.run_until_done(stream_state.run_chat_stream(stream, out, ck))
    return stream_state.chat_history(spark, out)


@query("stream_within_watermark", "SELECT DISTINCT arxiv_id FROM {state_events}")
def stream_within_watermark(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    out, ck = shared_dir(spark, "within"), shared_dir(spark, "checkpoint")
    stream = _landed(view(spark, sf, "state_events").select("arxiv_id", F.col("ts").cast("timestamp").alias("ts")), spark, "ts", 2)
    once = stream_feed.dedup_within(stream, "arxiv_id", "ts", "400 days")
    done = (
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        .trigger(availableNow=True).start()
    )
    stream_feed.run_until_done(done)
    return spark.read.parquet(out).select("arxiv_id")


# the same state when every micro-batch brings events from all times


@query("stream_state_shuffled", _STREAM_STARS)
def stream_state_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return stream_star_state(spark, sf, shuffled=True)


@query("stream_hides_shuffled", _STREAM_HIDES)
def stream_hides_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return stream_hides(spark, sf, shuffled=True)


@query("stream_annotations_shuffled", _STREAM_NOTES)
def stream_annotations_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return stream_annotations(spark, sf, shuffled=True)
