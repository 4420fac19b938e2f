"""Chat turns: append, clear, history and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Stored roles.
ROLES = ("user", "assistant")
#: Turns per snapshot part; a long chat becomes several parts instead of one huge row.
PART_TURNS = 500


def valid_turns(turns: DataFrame) -> DataFrame:
    """User turns as they are; assistant turns only when they say something."""
    return turns.where(
        F.col("role").isin(*ROLES) & ((F.col("role") == "user") | (F.coalesce("content", F.lit("")) != ""))
    )


def after_last_clear(turns: DataFrame, clears: DataFrame) -> DataFrame:
    """Drop what was said before a paper's latest clear event (``arxiv_id, seq``)."""
    last = clears.groupBy("arxiv_id").agg(F.max("seq").alias("_cleared"))
    kept = turns.join(last, "arxiv_id", "left")
    return kept.where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).drop("_cleared")


def turn_messages(turns: DataFrame) -> DataFrame:
    return valid_turns(turns).select("arxiv_id", "seq", "role", "content")


def chat_snapshot(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Stored form: ordered messages per paper, in parts of bounded length.

    Papers without turns have no row.
    """
    parts = valid_turns(turns).withColumn("part", F.floor(F.col("seq") / part_turns).cast("bigint"))
    return parts.groupBy("arxiv_id", "part").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"),
    )
