"""Ranking that survives a group holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.session import materialise

#: Ways a hot group is split before its final pass.
SPREAD = 64


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per group, in two passes.

    Each map task keeps `k` rows per group before anything is shuffled.  What is left
    of a group is then cut again in up to `SPREAD` tasks, by the task it came from,
    before one task sees ``SPREAD * k`` rows.  The result does not depend on the split.
    """
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= k)
        .drop("_part", "_rank")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    The limit of one applies on the map side, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def number_within(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], name: str
) -> DataFrame:
    """0-based position within each group, without sending a group to one task.

    `chunk` is a column that orders before `order` and splits a group into moderate
    pieces.  Rows are numbered per piece and shifted by the sizes of earlier pieces.
    """
    df = df.repartition(*keys, chunk)  # one exchange that both branches below share
    pieces = df.groupBy(*keys, chunk).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.withColumn("_pos", F.row_number().over(inside))
        .join(shift, [*keys, chunk])
        .withColumn(name, (F.col("_shift") + F.col("_pos") - 1).cast("bigint"))
        .drop("_shift", "_pos")
    )


def positioned(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based place of every row in the whole order, without one task that sees all rows.

    Rows are dealt by ranges of `order` and written sorted, with their place inside the
    range; the sizes of earlier ranges (one number per partition) are added.  Rows that are
    equal in `order` lie in one range, in no given sequence: let it end in a key.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the upper bits of this number are the partition, the lower 33 count within it
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "positions")
    piece, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        rows.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")  # at most one row per partition
        .withColumn(name, F.col("_start") + inside)
        .drop("_piece", "_start", "_at")
    )
