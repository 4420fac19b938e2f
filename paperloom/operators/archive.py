"""Snapshots of user state that write only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Left out of the comparison: it differs on every run.
VOLATILE = ("updated_at",)


def content_hash(df: DataFrame, ignore: Sequence[str] = VOLATILE) -> Column:
    """Digest of a row's content, nulls included."""
    cols = sorted(c for c in df.columns if c not in ignore)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def compare(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows with ``changed``: new, or other content than in the last snapshot."""
    now = current.withColumn("_hash", content_hash(current))
    before = previous.select(*keys, content_hash(previous).alias("_before"))
    joined = now.join(before, list(keys), "left")
    return joined.withColumn(
        "changed", F.coalesce(F.col("_hash") != F.col("_before"), F.lit(True))
    ).drop("_hash", "_before")


def changed_only(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    return compare(current, previous, keys).where("changed").drop("changed")


def changes(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What differs from the last snapshot, with ``op``: added, changed or removed.

    A removed entry keeps the content it had.
    """
    now = current.select(*keys, F.struct(*current.columns).alias("_now"), content_hash(current).alias("_hash"))
    shared = [c for c in current.columns if c in previous.columns]
    old = F.struct(*[F.col(c) if c in shared else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    before = previous.select(*keys, old.alias("_old"), content_hash(previous).alias("_before"))
    op = (
        F.when(F.col("_hash").isNull(), "removed").when(F.col("_before").isNull(), "added")
        .when(F.col("_hash") != F.col("_before"), "changed")
    )
    found = now.join(before, list(keys), "full_outer").withColumn("op", op).where("op is not null")
    return found.select(F.coalesce("_now", "_old").alias("_row"), "op").select("_row.*", "op")


def snapshot_summary(compared: DataFrame) -> DataFrame:
    """Entries checked and written, per state kind where there is a ``kind`` column."""
    keys = ["kind"] if "kind" in compared.columns else []
    return compared.groupBy(*keys).agg(
        F.count("*").alias("checked"), F.count_if("changed").alias("committed"), F.lit(True).alias("ok")
    )
