"""Writers.

A table store is a versioned table (`sources.store`): a base holds all rows up to its number,
later parts what was written since.  Adding costs what is added; readers take the newest
row per key.  A part counts once a version names it, so a failed write is never seen, and
writers at once lose nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.session import materialise
from paperloom.operators import analyses as A
from paperloom.operators import archive
from paperloom.operators.ranking import first_per_key
from paperloom.sources import store

KEY = ("arxiv_id",)


def append(df: DataFrame, path: str, number: int | None = None, tag: str | None = None) -> int:
    """Add rows as the next part; a given number or tag makes a repeated write replace itself."""
    return store.add(df.sparkSession, path, store.write(df, path), number, tag)


def _newest(spark: SparkSession, path: str, parts: store.Parts, keys: Sequence[str]) -> DataFrame:
    frames = [spark.read.parquet(f"{path}/{p.folder}").withColumn("_part", F.lit(p.number)).withColumn("_base", F.lit(p.base)) for p in parts]
    if len(parts) == 1 and parts[0].base:
        return frames[0].drop("_part", "_base")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    # a part written again under the number that a base has taken is newer than the base
    return first_per_key(rows, keys, [F.col("_part").desc(), F.col("_base").asc()]).drop("_part", "_base")


def current(spark: SparkSession, path: str, keys: Sequence[str] = KEY, version: int | None = None) -> DataFrame | None:
    """Newest row per key in the newest (or a given) version, null for an empty store."""
    parts = store.live(spark, path, version)[1]
    return _newest(spark, path, parts, keys) if parts else None


def compact(spark: SparkSession, path: str, keys: Sequence[str] = KEY) -> int | None:
    """Fold all parts into a base with the last part's number; parts added meanwhile stay."""
    parts = store.live(spark, path)[1]
    if not parts:
        return None
    return store.fold(spark, path, parts, store.write(_newest(spark, path, parts, keys), path))


def upsert_analyses(new: DataFrame, path: str, number: int | None = None, tag: str | None = None) -> DataFrame:
    """Add records, a new one replacing the stored one of its id; returns the current table."""
    append(A.latest(new), path, number, tag)
    table = current(new.sparkSession, path)
    assert table is not None
    return table


def update_index(new: DataFrame, path: str, number: int | None = None, tag: str | None = None) -> int:
    """Add the slim rows of new records to the index store."""
    return append(A.to_index(A.latest(new)), path, number, tag)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Index in index order."""
    rows = current(spark, path)
    return None if rows is None else rows.orderBy(*A.newest_first())


def write_index(analyses: DataFrame, path: str) -> None:
    """Rebuild the whole index as one base; what others add meanwhile stays on top of it."""
    spark = analyses.sparkSession
    parts = store.live(spark, path)[1]
    store.fold(spark, path, parts, store.write(A.to_index(analyses).orderBy(*A.newest_first()), path))


def write_json_records(payload: DataFrame, path: str) -> None:
    """Records as JSON lines, nulls included."""
    A.payload_json(payload).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_snapshot(state: DataFrame, path: str, keys: Sequence[str], kind: str) -> DataFrame:
    """Write the rows that changed since the last snapshot and return the summary.

    The folder of a kind holds the full state as a versioned table for the next comparison,
    and the changed rows as JSON under the number of the snapshot.  Raises `store.Conflict`
    where another snapshot was committed since this one read the last: then repeat it.
    """
    spark = state.sparkSession
    root = f"{path}/{kind}"
    states = f"{root}/state"
    last, parts = store.live(spark, states)
    if parts:  # the last snapshot may have ended between its commit and the naming of its changes
        store.place(spark, root, parts[-1].info["changes"], f"changes/{last}")
    previous = spark.read.parquet(f"{states}/{parts[-1].folder}") if parts else state.limit(0)
    folder = store.write(state, states)
    state = spark.read.parquet(f"{states}/{folder}")
    found = materialise(archive.changes(state, previous, keys), "changes")
    draft = f"drafts/{uuid.uuid4().hex}"
    found.write.json(f"{root}/{draft}")
    part = store.Part(last + 1, folder, True, None, {"changes": draft})
    store.commit(spark, states, lambda _: [part], expected=last)
    store.place(spark, root, draft, f"changes/{last + 1}")
    return state.agg(
        F.lit(kind).alias("kind"), F.count("*").alias("checked"), F.lit(found.count()).alias("committed"), F.lit(True).alias("ok")
    )


def write_digest(lines: DataFrame, path: str) -> None:
    """The document as text parts; in file order they read as one page."""
    ordered = lines.orderBy("part", "first_pos", "pos")
    ordered.select(F.col("html").alias("value")).write.mode("overwrite").text(path)

