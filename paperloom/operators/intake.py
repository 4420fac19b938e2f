"""Submitted links: find the id, see whether it is done, choose the topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.config import Topic
from paperloom.functions.ids import find_id
from paperloom.functions.text import strip
from paperloom.operators.shape import compute_once

# The topic used when none is configured.
ADHOC_TOPIC = Topic("ad-hoc", "Ad-hoc submission")


def triage(submissions: DataFrame, analyses: DataFrame) -> DataFrame:
    """``(sub_id, raw)`` to id and status: invalid, already_analysed or dispatched.

    The readiness poll is the same lookup.
    """
    done = analyses.select("arxiv_id").distinct().withColumn("_done", F.lit(True))
    found = compute_once(submissions, "arxiv_id", find_id(strip(F.coalesce("raw", F.lit("")))))
    return (
        found.join(done, "arxiv_id", "left")
        .withColumn(
            "status",
            F.when(F.col("arxiv_id").isNull(), "invalid")
            .when(F.col("_done"), "already_analysed")
            .otherwise("dispatched"),
        )
        .drop("_done")
    )


def resolve_topic(requested: Column, topics: Sequence[Topic]) -> Column:
    """Index of the topic with that name or label, else the first, else null."""
    chosen = F.lit(0) if topics else F.lit(None).cast("int")
    pairs: dict[str, int] = {}
    for i, topic in enumerate(topics):
        pairs.setdefault(topic.name, i)
        pairs.setdefault(topic.display, i)
    if not pairs:
        return chosen
    table = F.create_map(*[x for name, i in pairs.items() for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.try_element_at(table, requested), chosen)
