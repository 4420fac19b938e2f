"""State folds against a replay one event at a time, in batch and as a stream."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import archive, chats, state
from paperloom.session import shared_dir
from paperloom.sources import sinks, store
from paperloom.streaming import feed as SF, seen, state as SS

T0 = datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp, arxiv_id string, op string, topic string, note string"


def star_events(seed, n=400, keys="abcdef"):
    """A third of all events on one key, many at the same time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(keys)
        op = rng.choice(["star", "star", "star_replace", "unstar", "hide", "unhide"])
        rows.append(
            (i, T0 + timedelta(minutes=rng.randrange(600)), key, op, rng.choice([None, "t1", "t2"]), rng.choice([None, "n1", "n2"]))
        )
    return rows


def replay_stars(rows):
    stars = {}
    for _, ts, key, op, topic, note in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "unstar":
            stars.pop(key, None)
        elif op == "star_replace":
            stars[key] = (ts, topic, None)
        elif op == "star":
            old = stars.get(key, (ts, None, None))
            stars[key] = (old[0], topic if topic is not None else old[1], note if note is not None else old[2])
    return stars


def replay_hidden(rows):
    hidden = {}
    for _, ts, key, op, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "hide":
            hidden[key] = ts
        elif op == "unhide":
            hidden.pop(key, None)
    return hidden


@pytest.mark.parametrize("seed", range(3))
def test_star_and_hide_folds(spark, seed):
    rows = star_events(seed)
    df = spark.createDataFrame(rows, EVENTS)
    got = {r.arxiv_id: (r.starred_at, r.topic, r.note) for r in state.star_state(df).collect()}
    assert got == replay_stars(rows)
    # the latest hide decides the time, which is also the latest event of the pair here
    assert {r.arxiv_id: r.hidden_at for r in state.hide_state(df).collect()} == replay_hidden(rows)


def test_star_rules(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [
        (1, at(0), "a", "unstar", None, None),
        (2, at(1), "a", "star", "t", "n"),
        (3, at(90), "a", "star", None, None),
        (4, at(0), "b", "star", "t", "n"),
        (5, at(200), "b", "star_replace", None, "ignored"),
        (6, at(5), "c", "star", None, None),
        (7, at(5), "c", "unstar", None, None),
        (8, at(5), "d", "unstar", None, None),
        (9, at(5), "d", "star", None, None),
    ]
    got = {r.arxiv_id: (r.starred_at, r.topic, r.note) for r in state.star_state(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"a": (at(1), "t", "n"), "b": (at(200), None, None), "d": (at(5), None, None)}


NOTES = "event_id bigint, ts timestamp, arxiv_id string, note_id string, op string, stage string, quote string, note string"


def test_annotations_replay(spark):
    rng = random.Random(8)
    rows, kept = [], {}
    for i in range(300):
        ts = T0 + timedelta(minutes=i // 2)
        row = (
            i, ts, rng.choice("pq"), rng.choice("123"), rng.choice(["upsert", "upsert", "delete"]),
            rng.choice(["brief", "qa", "bad"]), rng.choice([" q1 ", "q2", "  "]), f" note {i} ",
        )
        rows.append(row)
        _, _, paper, note_id, op, stage, quote, note = row
        if op == "delete":
            kept.pop((paper, note_id), None)
        elif stage != "bad" and quote.strip():
            born = kept.get((paper, note_id), (ts,))[0]
            kept[(paper, note_id)] = (born, ts, stage, quote.strip(), note.strip())
    df = spark.createDataFrame(rows, NOTES)
    got = {
        (r.arxiv_id, r.note_id): (r.created_at, r.updated_at, r.stage, r.quote, r.note)
        for r in state.annotation_state(df).collect()
    }
    assert got == kept
    bad = state.rejected_notes(df).groupBy("reason").count().collect()
    assert {r.reason for r in bad} == {"invalid stage", "quote required"}


def test_anchor(spark):
    notes = spark.createDataFrame(
        [("p", "1", "brief", "bc"), ("p", "2", "brief", "zz"), ("p", "3", "qa", "x")],
        "arxiv_id string, note_id string, stage string, quote string",
    )
    sections = spark.createDataFrame([("p", "brief", "abcbc")], "arxiv_id string, stage string, section string")
    got = {r.note_id: (r.position, r.orphan) for r in state.anchor(notes, sections).collect()}
    assert got == {"1": (1, False), "2": (None, True), "3": (None, True)}


def in_files(spark, rows, schema, size):
    landing = shared_dir(spark, "landing")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(landing)
    return SF.file_stream(spark, landing, schema, 1)


def stars_in(spark, out):
    return {r.arxiv_id: (r.starred_at, r.topic, r.note) for r in SS.star_state(spark, out).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_streamed_stars_in_any_order(spark, seed):
    rows = star_events(5 + seed)
    random.Random(seed).shuffle(rows)
    rows += rows[::7]  # some arrive twice
    out, ck = shared_dir(spark, "stars"), shared_dir(spark, "ck")
    SF.run_until_done(SS.run_star_stream(in_files(spark, rows, EVENTS, 120), out, ck))
    want = replay_stars(set(rows))
    assert stars_in(spark, out) == want
    # folded batches give the same state, whatever the horizon, and newer events may follow
    for hours in (0, 4, 20):
        target = shared_dir(spark, "compact")
        SS.compact(spark, out, target, state.STAR_KEY, state.STAR_FIELDS, T0 + timedelta(hours=hours))
        assert stars_in(spark, target) == want
        late = [(1000 + i, T0 + timedelta(hours=hours, minutes=i % 7), k, op, t, n) for i, (_, _, k, op, t, n) in enumerate(star_events(9, 40))]
        SF.run_until_done(SS.run_star_stream(in_files(spark, late, EVENTS, 40), target, shared_dir(spark, "ck")))
        assert stars_in(spark, target) == replay_stars({*rows, *late})
    puts = spark.read.parquet(f"{target}/puts").where(F.col("ts") < F.lit(T0 + timedelta(hours=20)))
    assert puts.groupBy("arxiv_id").count().where("count > 1").isEmpty()


def test_hides_in_any_order(spark):
    rows = star_events(11)
    random.Random(1).shuffle(rows)
    out, ck = shared_dir(spark, "hides"), shared_dir(spark, "ck")
    SF.run_until_done(SS.run_hide_stream(in_files(spark, rows, EVENTS, 120), out, ck))
    assert {r.arxiv_id: r.hidden_at for r in SS.hide_state(spark, out).collect()} == replay_hidden(rows)


def test_streamed_hides_notes_and_chats(spark):
    rows = sorted(star_events(6), key=lambda r: (r[1], r[0]))
    landing, out, ck = (shared_dir(spark, n) for n in ("landing", "hides", "ck"))
    for i in range(0, len(rows), 90):
        spark.createDataFrame(rows[i : i + 90], EVENTS).coalesce(1).write.mode("append").parquet(landing)
    SF.run_until_done(SS.run_hide_stream(SF.file_stream(spark, landing, EVENTS, 1), out, ck))
    assert {r.arxiv_id: r.hidden_at for r in SS.hide_state(spark, out).collect()} == replay_hidden(rows)

    at = lambda m: T0 + timedelta(minutes=m)
    notes = [
        [(1, at(0), "p", "1", "upsert", "qa", "q", "a"), (2, at(1), "p", "2", "upsert", "qa", "q", "b")],
        [(3, at(2), "p", "1", "upsert", "brief", "q2", "c"), (4, at(3), "p", "2", "delete", None, None, None)],
        [(5, at(4), "p", "2", "upsert", "qa", "again", ""), (6, at(5), "p", "3", "upsert", "bad", "q", "")],
    ]
    landing, out, ck = (shared_dir(spark, n) for n in ("landing", "notes", "ck"))
    for rows in notes:
        spark.createDataFrame(rows, NOTES).coalesce(1).write.mode("append").parquet(landing)
    SF.run_until_done(SS.run_note_stream(SF.file_stream(spark, landing, NOTES, 1), out, ck))
    got = {r.note_id: (r.created_at, r.updated_at, r.stage, r.quote) for r in SS.annotation_state(spark, out).collect()}
    assert got == {"1": (at(0), at(2), "brief", "q2"), "2": (at(4), at(4), "qa", "again")}

    schema = "arxiv_id string, seq bigint, role string, content string"
    landing, out, ck = (shared_dir(spark, n) for n in ("landing", "chats", "ck"))
    for rows in ([("p", 0, "user", "old")], [("p", 1, "clear", ""), ("p", 2, "user", "new")], [("p", 3, "assistant", "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    SF.run_until_done(SS.run_chat_stream(SF.file_stream(spark, landing, schema, 1), out, ck))
    assert [r.content for r in SS.chat_history(spark, out).collect()] == ["new"]


def test_incremental_run_handles_a_key_once_and_resumes(spark):
    landing, out, ck = (shared_dir(spark, n) for n in ("landing", "inc", "ck"))
    schema = "arxiv_id string, n int"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = SF.file_stream(spark, landing, schema, 1)
        SF.run_until_done(SF.run_incremental(stream, out, ck, "arxiv_id", ["n"], lambda new: new))

    land([("a", 2), ("a", 1), ("b", 5)])
    land([("b", 0), ("c", 3)])
    run()
    assert sorted(tuple(r) for r in SF.read_rows(spark, out).collect()) == [("a", 1), ("b", 5), ("c", 3)]
    land([("c", 1), ("d", 9)])
    run()
    assert sorted(r.arxiv_id for r in SF.read_rows(spark, out).collect()) == ["a", "b", "c", "d"]


def test_a_repeated_batch_replaces_itself(spark):
    out = shared_dir(spark, "batch")
    df = spark.createDataFrame([("a",)], "k string")
    SF.append_once(df, out, 3)
    SF.append_once(df, out, 3)
    assert spark.read.parquet(out).count() == 1


def test_chat_clear_and_snapshot(spark):
    turns = spark.createDataFrame(
        [
            ("p", 0, "user", "old"), ("p", 2, "user", "hi"), ("p", 3, "assistant", ""), ("p", 4, "assistant", "yo"),
            ("p", 5, "system", "s"), ("q", 0, "system", "s"), ("r", 0, "user", ""),
        ],
        "arxiv_id string, seq bigint, role string, content string",
    )
    clears = spark.createDataFrame([("p", 1)], "arxiv_id string, seq bigint")
    left = chats.after_last_clear(turns, clears)
    got = chats.chat_snapshot(left, part_turns=4).orderBy("arxiv_id", "part").collect()
    assert [(r.arxiv_id, r.part, [m.content for m in r.messages]) for r in got] == [
        ("p", 0, ["hi"]), ("p", 1, ["yo"]), ("r", 0, [""]),
    ]


def test_archive_skips_what_only_differs_in_time(spark):
    schema = "arxiv_id string, note string, updated_at string"
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("gone", "1", "x"), ("n", None, "x")], schema)
    new = spark.createDataFrame([("a", "1", "y"), ("b", "2", "y"), ("new", "1", "y"), ("n", None, "y")], schema)
    assert sorted(r.arxiv_id for r in archive.changed_only(new, old, ["arxiv_id"]).collect()) == ["b", "new"]
    row = archive.snapshot_summary(archive.compare(new, old, ["arxiv_id"])).first()
    assert (row.checked, row.committed, row.ok) == (4, 2, True)


def test_snapshot_sink(spark):
    path = shared_dir(spark, "snap")
    schema = "arxiv_id string, note string"
    first = spark.createDataFrame([("a", "1"), ("b", "1")], schema)
    assert tuple(sinks.write_snapshot(first, path, ["arxiv_id"], "stars").first()) == ("stars", 2, 2, True)
    second = first.withColumn("note", F.when(F.col("arxiv_id") == "b", "2").otherwise(F.col("note")))
    assert tuple(sinks.write_snapshot(second, path, ["arxiv_id"], "stars").first()) == ("stars", 2, 1, True)
    assert [r.arxiv_id for r in spark.read.json(f"{path}/stars/changes/1").collect()] == ["b"]


def test_snapshot_names_what_was_removed(spark):
    path = shared_dir(spark, "gone")
    schema = "arxiv_id string, note string"
    sinks.write_snapshot(spark.createDataFrame([("a", "1"), ("b", "1")], schema), path, ["arxiv_id"], "stars")
    later = spark.createDataFrame([("b", "2"), ("c", "3")], schema)
    assert tuple(sinks.write_snapshot(later, path, ["arxiv_id"], "stars").first()) == ("stars", 2, 3, True)
    rows = {r.arxiv_id: (r.op, r.note) for r in spark.read.json(f"{path}/stars/changes/1").collect()}
    assert rows == {"a": ("removed", "1"), "b": ("changed", "2"), "c": ("added", "3")}


def test_seen_keys_over_many_batches_open_few_buckets(spark):
    out = shared_dir(spark, "seen")
    scratch = shared_dir(spark, "maybe")
    keys = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("k"))
    for batch in range(7):
        seen.merge(spark, out, "k", batch, fan=3)
        # empty batches (3 and 4) leave runs without rows
        seen.add(keys(0, 0) if batch in (3, 4) else keys(batch * 100, batch * 100 + 100), out, batch, buckets=8)
    runs = store.live(spark, out)[1]
    assert [(p.info["level"], p.info["n"]) for p in runs] == [(1, 300), (1, 100), (0, 100)]
    found = lambda df, batch: set() if (r := seen.find(df, out, batch, scratch)) is None else {x.k for x in r.collect()}
    assert found(keys(50, 900), 7) == {f"k{i}" for i in [*range(50, 300), *range(500, 700)]}
    assert found(keys(600, 700), 6) == set()  # its own run does not count when batch 6 is repeated
    # keys that were never stored: hardly any passes the filters, so hardly any bucket is opened
    assert found(keys(5_000, 6_000), 7) == set()
    assert spark.read.parquet(scratch).select("k").distinct().count() < 150
    seen.add(keys(600, 650), out, 6)
    assert found(keys(600, 700), 7) == {f"k{i}" for i in range(600, 650)}
    nulls = spark.createDataFrame([(None,), ("k1",)], "k string")
    assert found(nulls, 7) == {"k1"}


def test_rows_land_in_ranges_and_copies(spark):
    """Every row lands as often as asked, copies together, each file a range."""
    from paperloom.checks.q_state import _landed

    rows = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "n int").withColumn("wide", F.lit("read"))
    stream = _landed(rows, spark, "n", 4, copies=2)
    path = max(Path(spark.conf.get("spark.checkpoint.dir")).glob("landing-*"), key=lambda p: p.stat().st_mtime)
    landed = spark.read.parquet(str(path))
    assert stream.columns == landed.columns == ["n", "wide"]
    found = landed.groupBy("n").count().collect()
    assert sorted((-1 if r.n is None else r.n, r["count"]) for r in found) == [(i, 2) for i in range(-1, 40)]
    files = landed.where("n is not null").groupBy(F.input_file_name().alias("f")).agg(F.min("n").alias("a"), F.max("n").alias("b")).collect()
    spans = sorted((r.a, r.b) for r in files)
    assert len(spans) == 4 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    empty = _landed(rows.where("n < 0"), spark, "n", 4)
    assert empty.columns == ["n", "wide"]
