"""Shards along a Hilbert curve over quantised metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from paperloom.llm.common import numbered, python_ready

BITS = 6


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points whose coordinates lie in [0, 2**bits)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations from the coarsest square inwards
        low = bit - 1
        for k in range(len(x)):
            set_ = (x[k] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        bit >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << 1) | (((axis ^ turn) >> b) & 1)
    return out


def _quantised(docs: DataFrame, dims: list[str], bits: int) -> list:
    """One integer column per dimension: numbers by approximate quantiles, other values by a hash."""
    cells = 1 << bits
    numeric = [d for d in dims if isinstance(docs.schema[d].dataType, T.NumericType)]
    cuts: dict[str, list] = {}
    if numeric:
        at = [i / cells for i in range(1, cells)]
        row = docs.agg(*[F.percentile_approx(d, at, 1000).alias(d) for d in numeric]).first()
        cuts = {d: sorted(set(row[d] or [])) for d in numeric}
    out = []
    for d in dims:
        if d in cuts:
            edges = F.array(*[F.lit(c) for c in cuts[d]]) if cuts[d] else F.array().cast("array<double>")
            below = F.filter(edges, lambda e: F.col(d) >= e)  # noqa: B023 - used at once
            out.append(F.greatest(F.size(below), F.lit(0)))
        else:
            out.append(F.coalesce(F.pmod(F.xxhash64(d), F.lit(cells)), F.lit(0)))
    return out


def hilbert_shards(
    docs: DataFrame, dims: list[str], n_shards: int, law: str = "rows", size: str | None = None, ids: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """`docs` with ``law, shard, slot, grown_shard`` added (same-named columns are replaced).

    Rows are ordered by their index on the Hilbert curve over `dims`, then by `ids`, and
    cut into `n_shards` runs: law ``rows`` makes row counts differ by at most one, law
    ``bytes`` makes sums of column `size` near equal.  ``slot`` counts from 0 in a shard.
    Files written per shard then cover a small range of every dimension.  Nulls take cell
    0 of a number or their own hash cell; equal rows are adjacent and keep their order by
    chance, as nothing tells them apart.  An empty table gives no rows.
    ``grown_shard`` belongs to laws on keys and is null.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    if law == "bytes" and not size:
        raise ValueError("law bytes needs a size column")
    python_ready(docs.sparkSession)
    docs = docs.drop("law", "shard", "slot", "grown_shard")

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], BITS))

    cells = F.struct(*[c.cast("long").alias(f"c{i}") for i, c in enumerate(_quantised(docs, dims, BITS))])
    # the input's columns stay in a struct, so that none meets a helper's name
    weight = F.col(size).cast("long") if law == "bytes" else F.lit(1).cast("long")
    keys = [F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)]
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(inner.alias("_row_in"), index(cells).alias("_curve"), F.xxhash64(*ids).alias("_spread"), weight.alias("_size"), *keys)
    rows = numbered(keyed, ["_curve", "_spread", *[f"_id{i}" for i in range(len(ids))]], "_size" if law == "bytes" else None, "hilbert")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if law == "rows":
        shard = F.expr(f"_start * {n_shards} div {max(total, 1)}")
    else:  # a row belongs where its middle lies
        shard = F.least(F.lit(n_shards - 1), F.expr(f"(2 * _start + _size) * {n_shards} div {2 * max(total, 1)}"))
    rows = rows.withColumn("shard", shard.cast("int"))
    if law == "rows":
        first = F.ceil(F.col("shard").cast("decimal(20,0)") * F.lit(total).cast("decimal(18,0)") / F.lit(n_shards))
        rows = rows.withColumn("slot", F.col("_start") - first.cast("long"))
    else:
        firsts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
        from pyspark.sql import Window

        before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        firsts = firsts.withColumn("_gone", F.coalesce(before, F.lit(0))).drop("_n")
        rows = rows.join(firsts, ["shard", "_part"]).withColumn("slot", F.col("_gone") + F.col("_row") - F.col("_low"))
    return rows.select(
        "_row_in.*", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard may be several files."""
    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
