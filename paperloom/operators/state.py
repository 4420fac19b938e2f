"""User state out of events: stars, hides, notes.  Pure folds, no user code per row.

State is kept as registers that only grow: per key the place (time, event id) of the last
reset, of the last put, and of the last value of each field, each a maximum.  Merging
registers is taking maxima again, so events may arrive in any order, in any split and more
than once.  Only the *first* put of a key's present life is no maximum: a reset that
arrives late moves it.  So the places of puts are kept as narrow rows beside the registers,
and the first one at or after the reset is looked up.  Nothing here orders the events of a
key, so a key that holds a large share of all events spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.text import strip
from paperloom.operators.ranking import positioned

# Sections a note may belong to.
NOTE_STAGES = ("relevance", "brief", "problem", "solution", "methodology", "experiments", "conclusion", "qa")


def place() -> Column:
    """Where an event stands among all events."""
    return F.struct("ts", "event_id")


def registers(events: DataFrame, keys: Sequence[str], drop: Column, replace: Column, fields: Sequence[str]) -> DataFrame:
    """One row per key: ``reset, put`` (places) and per field ``(ts, event_id, value)`` of its last value.

    `drop` marks events that delete a key, `replace` those that start it over; all but
    `drop` put.  Every aggregate is a maximum, combined before the shuffle.
    """
    return events.groupBy(*keys).agg(
        F.max(F.when(drop | replace, place())).alias("reset"),
        F.max(F.when(~drop, place())).alias("put"),
        *[F.max(F.when(~drop & F.col(f).isNotNull(), F.struct("ts", "event_id", F.col(f).alias("value")))).alias(f) for f in fields],
    )


def put_places(events: DataFrame, keys: Sequence[str], drop: Column) -> DataFrame:
    """``keys, ts, event_id`` of every put."""
    return events.where(~drop).select(*keys, "ts", "event_id")


def merge(parts: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Registers of several folds as one row per key."""
    return parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("reset", "put", *fields)])


def since_reset(puts: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Puts at or after their key's last reset."""
    resets = merged.select(*keys, "reset")
    return puts.join(resets, list(keys)).where(F.col("reset").isNull() | (place() >= F.col("reset"))).drop("reset")


def current(merged: DataFrame, puts: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys that exist after their last event: ``first_ts`` and the fields' values since the reset."""
    alive = merged.where(F.col("put").isNotNull() & (F.col("reset").isNull() | (F.col("put") >= F.col("reset"))))
    first = since_reset(puts, alive, keys).groupBy(*keys).agg(F.min("ts").alias("first_ts"))

    def value(field: str) -> Column:
        at = F.struct(F.col(f"{field}.ts"), F.col(f"{field}.event_id"))
        return F.when(F.col("reset").isNull() | (at >= F.col("reset")), F.col(f"{field}.value")).alias(field)

    return alive.join(first, list(keys)).select(*keys, "first_ts", *[value(f) for f in fields])


STAR_FIELDS = ("topic", "note")


STAR_KEY = ("arxiv_id",)


def star_events(events: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Star events ``(event_id, ts, arxiv_id, op, topic, note)``, and which of them delete and start over."""
    mine = events.where(F.col("op").isin("star", "star_replace", "unstar"))
    mine = mine.withColumn("note", F.when(F.col("op") == "star", F.col("note")))
    return mine, F.col("op") == "unstar", F.col("op") == "star_replace"


def star_state(events: DataFrame) -> DataFrame:
    """Current stars.

    ``star`` keeps the first time and any earlier topic and note, ``star_replace``
    starts over without a note, ``unstar`` deletes.
    """
    mine, drop, replace = star_events(events)
    whole = registers(mine, STAR_KEY, drop, replace, STAR_FIELDS)
    return current(whole, put_places(mine, STAR_KEY, drop), STAR_KEY, STAR_FIELDS).withColumnRenamed("first_ts", "starred_at")


def hide_registers(events: DataFrame) -> DataFrame:
    """The last hide or unhide per paper, ``(arxiv_id, last)``; a maximum, like the registers above."""
    mine = events.where(F.col("op").isin("hide", "unhide"))
    return mine.groupBy("arxiv_id").agg(F.max(F.struct("ts", "event_id", "op")).alias("last"))


def hidden(parts: DataFrame) -> DataFrame:
    """Hidden papers out of the registers of several folds."""
    whole = parts.groupBy("arxiv_id").agg(F.max("last").alias("last"))
    return whole.where(F.col("last.op") == "hide").select("arxiv_id", F.col("last.ts").alias("hidden_at"))


def hide_state(events: DataFrame) -> DataFrame:
    """Hidden papers with the time of the last ``hide``; the latest event decides."""
    return hidden(hide_registers(events))


def note_problem() -> Column:
    """Why an upsert is refused, null when it is fine."""
    return (
        F.when(F.col("op") == "delete", F.lit(None).cast("string"))
        .when(F.coalesce("arxiv_id", F.lit("")) == "", "arxiv_id required")
        .when(~F.coalesce(F.col("stage").isin(*NOTE_STAGES), F.lit(False)), "invalid stage")
        .when(strip(F.coalesce("quote", F.lit(""))) == "", "quote required")
    )


def valid_notes(events: DataFrame) -> DataFrame:
    """Accepted note events, quote and note trimmed."""
    return (
        events.where(note_problem().isNull())
        .withColumn("quote", strip(F.col("quote")))
        .withColumn("note", strip(F.coalesce("note", F.lit(""))))
    )


def rejected_notes(events: DataFrame) -> DataFrame:
    """Refused note events with the reason."""
    return events.withColumn("reason", note_problem()).where(F.col("reason").isNotNull())


NOTE_KEY = ("arxiv_id", "note_id")
NOTE_FIELDS = ("stage", "quote", "note", "updated_at")


def note_events(events: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Accepted note events, and which of them delete and start over (none does)."""
    return valid_notes(events).withColumn("updated_at", F.col("ts")), F.col("op") == "delete", F.lit(False)


def annotation_state(events: DataFrame) -> DataFrame:
    """Notes per (paper, note): creation time survives updates, a delete forgets it."""
    mine, drop, replace = note_events(events)
    whole = registers(mine, NOTE_KEY, drop, replace, NOTE_FIELDS)
    return current(whole, put_places(mine, NOTE_KEY, drop), NOTE_KEY, NOTE_FIELDS).withColumnRenamed("first_ts", "created_at")


def _newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("arxiv_id"), F.col("note_id")]


def newest_notes(notes: DataFrame) -> DataFrame:
    return notes.orderBy(*_newest())


def note_positions(notes: DataFrame) -> DataFrame:
    """Notes with their place among all, newest first."""
    return positioned(notes, _newest())


def state_list(state: DataFrame) -> DataFrame:
    """Number of entries of a state table."""
    return state.agg(F.count("*").alias("n"))


def anchor(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Where a note's quote first occurs in its section (0-based), or that it has none.

    `sections` has one text per ``(arxiv_id, stage)``.
    """
    joined = notes.join(sections, ["arxiv_id", "stage"], "left")
    at = F.instr(F.coalesce("section", F.lit("")), F.col("quote"))
    return joined.withColumn("position", F.when(at > 0, at - 1)).withColumn("orphan", at == 0).drop("section")
