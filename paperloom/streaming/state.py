"""User state kept up to date from event streams.

Stars and notes: each micro-batch folds its own events to registers (one small row per key)
and appends them, with the places of its puts.  The current state is the merge of those
rows; merging takes maxima, so it does not matter in which order, or how often, events
arrive, and a batch costs what arrived and not what is stored.  A batch that runs again
replaces its own folder.  Hides are a single register, which the state store keeps: a batch
writes the keys that it touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.dates import instant
from paperloom.operators import chats, state
from paperloom.operators.state import NOTE_FIELDS, NOTE_KEY, STAR_FIELDS, STAR_KEY
from paperloom.streaming.feed import BATCH, append_once


def _run(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch that is due to `handle`, then stop."""
    return (
        events.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _register_stream(
    events: DataFrame, out: str, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, Column, Column]],
    keys: Sequence[str], fields: Sequence[str],
) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        mine, drop, replace = split(batch)
        append_once(state.registers(mine, keys, drop, replace, fields), f"{out}/registers", batch_id)
        append_once(state.put_places(mine, keys, drop), f"{out}/puts", batch_id)

    return _run(events, checkpoint, handle)


def run_star_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _register_stream(events, out, checkpoint, state.star_events, STAR_KEY, STAR_FIELDS)


def run_note_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return _register_stream(events, out, checkpoint, state.note_events, NOTE_KEY, NOTE_FIELDS)


def run_hide_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The state store merges; a batch writes the registers that it changed, whole."""
    return _run(state.hide_registers(events), checkpoint, lambda batch, batch_id: append_once(batch, out, batch_id), "update")


def run_chat_stream(turns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append turns as they arrive; rows with the role ``clear`` mark where a history restarts."""
    return _run(turns, checkpoint, lambda batch, batch_id: append_once(batch, out, batch_id))


def _stored(spark: SparkSession, out: str, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merged registers and put places of all batches."""
    whole = state.merge(spark.read.parquet(f"{out}/registers"), keys, fields)
    return whole, spark.read.parquet(f"{out}/puts").drop(BATCH)


def star_state(spark: SparkSession, out: str) -> DataFrame:
    return state.current(*_stored(spark, out, STAR_KEY, STAR_FIELDS), STAR_KEY, STAR_FIELDS).withColumnRenamed("first_ts", "starred_at")


def annotation_state(spark: SparkSession, out: str) -> DataFrame:
    return state.current(*_stored(spark, out, NOTE_KEY, NOTE_FIELDS), NOTE_KEY, NOTE_FIELDS).withColumnRenamed("first_ts", "created_at")


def hide_state(spark: SparkSession, out: str) -> DataFrame:
    return state.hidden(spark.read.parquet(out))


def chat_history(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out).drop(BATCH)
    return chats.turn_messages(chats.after_last_clear(rows, rows.where("role = 'clear'").select("arxiv_id", "seq")))


def compact(spark: SparkSession, out: str, target: str, keys: Sequence[str], fields: Sequence[str], before: datetime) -> None:
    """Fold the batches of a star or note stream to one, as the start of a new folder.

    No event before `before` may arrive any more.  Until then every put may still become
    the first one by a late reset; of older puts only the first since the reset is kept,
    and keys that were deleted before are forgotten.
    """
    whole, puts = _stored(spark, out, keys, fields)
    horizon = instant(before)
    held = F.col("put") >= F.coalesce("reset", "put")
    recent = F.coalesce(F.col("reset.ts") >= horizon, F.lit(False)) | F.coalesce(F.col("put.ts") >= horizon, F.lit(False))
    whole = whole.where(F.coalesce(held, F.lit(False)) | recent)
    old = state.since_reset(puts.where(F.col("ts") < horizon), whole, keys).groupBy(*keys).agg(F.min(state.place()).alias("first"))
    kept = old.select(*keys, "first.ts", "first.event_id").union(puts.where(F.col("ts") >= horizon).select(*keys, "ts", "event_id"))
    append_once(whole, f"{target}/registers", -1)
    append_once(kept, f"{target}/puts", -1)
