"""Versioned tables (writers at once, repeated writes, old versions), readers with rejects, positions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators.ranking import positioned
from paperloom.session import shared_dir
from paperloom.sources import feed, records, sinks, store

SCHEMA = "arxiv_id string, n int"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(spark, path, version=None):
    return {tuple(r) for r in sinks.current(spark, path, version=version).collect()}


def interleave(monkeypatch, other):
    """Let `other` write between the moment a commit has read the version and its rename."""
    put, state = store._Files.put_new, {"left": 1}

    def late(self, name, text):
        if state["left"]:
            state["left"] -= 1
            other()
        return put(self, name, text)

    monkeypatch.setattr(store._Files, "put_new", late)


def test_two_appends_at_once_keep_both(spark, monkeypatch):
    path = shared_dir(spark, "store")
    sinks.append(rows(spark, ("a", 1)), path)
    interleave(monkeypatch, lambda: sinks.append(rows(spark, ("b", 2), ("c", 2)), path))
    assert sinks.append(rows(spark, ("c", 3)), path) == 2
    # the later commit is the newer one, though it began first
    assert content(spark, path) == {("a", 1), ("b", 2), ("c", 3)}
    assert content(spark, path, version=1) == {("a", 1), ("b", 2), ("c", 2)}
    assert [p.number for p in store.live(spark, path)[1]] == [0, 1, 2]


def test_append_during_compaction_stays_newer_than_the_base(spark, monkeypatch):
    path = shared_dir(spark, "store")
    sinks.append(rows(spark, ("a", 1)), path)
    sinks.append(rows(spark, ("b", 1)), path)
    interleave(monkeypatch, lambda: sinks.append(rows(spark, ("a", 5)), path))
    assert sinks.compact(spark, path) == 1
    assert [(p.number, p.base) for p in store.live(spark, path)[1]] == [(1, True), (2, False)]
    assert content(spark, path) == {("a", 5), ("b", 1)}


def test_two_compactions_at_once_refuse_the_second(spark, monkeypatch):
    path = shared_dir(spark, "store")
    sinks.append(rows(spark, ("a", 1)), path)
    interleave(monkeypatch, lambda: sinks.compact(spark, path))
    with pytest.raises(store.Conflict):
        sinks.compact(spark, path)
    assert content(spark, path) == {("a", 1)}


def test_a_repeated_run_replaces_itself(spark):
    path = shared_dir(spark, "store")
    assert sinks.append(rows(spark, ("a", 1), ("b", 1)), path, tag="monday") == 0
    assert sinks.append(rows(spark, ("a", 2)), path, tag="tuesday") == 1
    assert sinks.append(rows(spark, ("a", 7)), path, tag="monday") == 0
    assert content(spark, path) == {("a", 2)}
    # once folded, what is written again counts as newest
    sinks.compact(spark, path)
    assert sinks.append(rows(spark, ("a", 8)), path, tag="monday") == 2
    assert content(spark, path) == {("a", 8)}
    assert sinks.append(rows(spark, ("b", 9)), path, number=1) == 1
    assert content(spark, path) == {("a", 8), ("b", 9)}


def test_snapshots_at_once_refuse_the_second(spark, monkeypatch):
    path = shared_dir(spark, "snap")
    first, second = rows(spark, ("a", 1)), rows(spark, ("a", 1), ("b", 1))
    sinks.write_snapshot(first, path, ["arxiv_id"], "stars")
    interleave(monkeypatch, lambda: sinks.write_snapshot(second, path, ["arxiv_id"], "stars"))
    with pytest.raises(store.Conflict):
        sinks.write_snapshot(first, path, ["arxiv_id"], "stars")
    assert [(r.arxiv_id, r.op) for r in spark.read.json(f"{path}/stars/changes/1").collect()] == [("b", "added")]
    assert sinks.write_snapshot(second, path, ["arxiv_id"], "stars").first().committed == 0


def test_changes_of_an_interrupted_snapshot_are_named_by_the_next(spark, monkeypatch):
    path = shared_dir(spark, "snap")
    with monkeypatch.context() as m:
        m.setattr(store, "place", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            sinks.write_snapshot(rows(spark, ("a", 1)), path, ["arxiv_id"], "stars")
    assert sinks.write_snapshot(rows(spark, ("a", 2)), path, ["arxiv_id"], "stars").first().committed == 1
    assert [(r.arxiv_id, r.n, r.op) for r in spark.read.json(f"{path}/stars/changes/0").collect()] == [("a", 1, "added")]


def test_old_versions_go_with_what_only_they_name(spark):
    path = shared_dir(spark, "store")
    for n in range(4):
        sinks.append(rows(spark, ("a", n)), path)
    sinks.compact(spark, path)
    uncommitted = store.write(rows(spark, ("z", 0)), path)
    assert store.forget(spark, path, keep=1) == 4
    assert content(spark, path) == {("a", 3)}
    assert spark.read.parquet(f"{path}/{uncommitted}").count() == 1
    assert store.forget(spark, path, keep=1) == 0


def test_an_empty_store(spark):
    path = shared_dir(spark, "store")
    assert store.live(spark, path) == (-1, []) and sinks.compact(spark, path) is None and store.forget(spark, path) == 0


def test_broken_feed_entries_cost_only_themselves(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'
    whole = "<entry><id>http://x/abs/{0}v1</id><title>t{0}</title></entry>\n"
    broken = "<entry><id>http://x/abs/9</id><title>t</titel></entry>"
    (tmp_path / "a.xml").write_text(head + whole.format(1) + broken + whole.format(2) + "<entry><title>x</title></entry></feed>")
    (tmp_path / "b.xml").write_text('<entry lang="en"><id>http://x/abs/3v1</id><title>t3</title></entry><entry><id>http://x/abs/4</id>')
    (tmp_path / "c.xml").write_text("")
    got = feed.read_feed(spark, str(tmp_path / "*.xml"), datetime(2024, 1, 1)).collect()
    assert sorted(r.arxiv_id for r in got) == ["1", "2", "3"]
    refused = feed.rejected_entries(spark, str(tmp_path / "*.xml")).collect()
    assert sorted((r.file[-5:], r.reason) for r in refused) == [
        ("a.xml", feed.BROKEN), ("a.xml", feed.WITHOUT_ID), ("b.xml", feed.UNFINISHED),
    ]
    assert next(r.xml for r in refused if r.reason == feed.BROKEN) == broken


def test_refused_documents_have_a_reason(spark, tmp_path):
    lines = ['{"arxiv_id":"1","title":"t"}', "{oops", "[1]", "null", '{"title":"t"}', '{"arxiv_id":""}', "", '{"arxiv_id":"1","title":"t"}']
    (tmp_path / "rows.json").write_text("\n".join(lines))
    got = [r.arxiv_id for r in records.read_analyses(spark, str(tmp_path), lines=True).where("arxiv_id <> ''").collect()]
    assert got == ["1", "1"]
    refused = [r.reason for r in records.rejected_analyses(spark, str(tmp_path), lines=True).collect()]
    assert refused == [records.NO_JSON, records.NO_OBJECT, records.NO_OBJECT, records.NO_ID, records.NO_ID, records.NO_JSON]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_positions_in_order(spark, n):
    data = [((i * 7919) % 13 if i % 5 else None, i) for i in range(n)]
    df = spark.createDataFrame(data, "a int, b int")
    got = positioned(df, [F.col("a").desc_nulls_last(), F.col("b").asc()]).collect()
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(n))
