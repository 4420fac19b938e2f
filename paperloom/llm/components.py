"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node onto its smallest neighbour (or itself)."""
    near = _both_ways(edges) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    lowest = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m")
    )
    hung = near.join(lowest, F.col("u") == F.col("node"))
    if large:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select(F.col("node").alias("u"), F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of `edges` (u, v); component is its smallest node.

    Each round writes its edges to the shared folder, which cuts the lineage; the number
    of rounds grows with the logarithm of the longest path.
    """
    edges = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    last = None
    while True:
        edges = materialise(_stars(_stars(edges, large=True), large=False), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
