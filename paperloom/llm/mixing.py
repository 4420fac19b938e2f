"""Mix sources to target weights: budgets pass down a tree, leaves take token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.session import materialise

#: Hex digits of the seeded order that are summed before rows are ordered.
SLICE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(column) == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``capacity``.

    With the children ordered by capacity per weight, a child is filled as long as its
    capacity is within its share of what is left; the others share the rest by weight.
    So a child's shortage goes to its siblings, and what a whole family cannot take was
    never given to it, as its parent's capacity is the sum of theirs.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(child).asc_nulls_first())
    wide = "decimal(38,0)"
    gone = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(wide)
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(wide)
    stepped = nodes.withColumn("_gone", gone).withColumn("_weights", weights).withColumn(
        "_full", F.expr(f"cast(capacity as {wide}) * _weights <= cast(weight as {wide}) * (budget - _gone)")
    )
    family = Window.partitionBy(*parent)
    open_ = F.when(~F.col("_full"), F.struct("_gone", "_weights"))
    return (
        stepped.withColumn("_open", F.min(open_).over(family))
        .withColumn(
            "share",
            F.when(F.col("_full"), F.col("capacity")).otherwise(
                F.expr(f"cast(weight as {wide}) * (budget - _open._gone) div _open._weights")
            ),
        )
        .drop("_gone", "_weights", "_full", "_open", "budget")
    )


def _same(columns: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def leaf_budgets(
    supply: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int
) -> DataFrame:
    """``levels..., supply, share`` per leaf that has tokens; `supply` has the levels and ``supply``."""
    total = supply.agg(F.sum("supply")).first()[0] or 0
    leaves = supply.where("supply > 0").withColumn("capacity", F.col("supply") * max_epochs)
    for level in levels:
        leaves = leaves.where(_weight(level, weights.get(level, {})) > 0)
    most = leaves.agg(F.sum("capacity")).first()[0] or 0
    above, parent = None, []
    for depth, level in enumerate(levels):
        here = levels[: depth + 1]
        nodes = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(min(total * share[0] // share[1], most)))
        else:
            up = above.withColumnsRenamed({p: f"_{p}" for p in parent} | {"share": "budget"})
            nodes = nodes.join(up, _same(parent, "_"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        above = _share(nodes, parent, level).select(*here, "share")
        parent = here
    up = above.withColumnsRenamed({p: f"_{p}" for p in levels})
    return leaves.join(up, _same(levels, "_")).select(*levels, "supply", "share")


def mix(
    rows: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int,
) -> DataFrame:
    """``doc_id, epoch, n_tokens`` and the levels of every selected (document, epoch).

    `rows` has ``doc_id, n_tokens`` and the levels.  The budget is ``share[0] / share[1]``
    of all tokens.  A level's value without a weight weighs 1, weight 0 excludes it; null
    is a value of its own.  A leaf may be read `max_epochs` times; its whole epochs are
    taken with all documents, the last with the longest prefix within the budget in the
    order of ``md5(seed:epoch:doc_id)`` (equal ids: shorter first).  Leaves without
    tokens give nothing; a null doc_id orders as an empty id.

    The prefix is found by slices of the order: their token sums are added up per leaf,
    slices before the end are taken as they are, and only the slice at the end is ordered.
    """
    supply = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"))
    supply = materialise(supply, "supply")
    leaves = leaf_budgets(supply, levels, weights, share, max_epochs)
    leaves = materialise(
        leaves.select(
            *[F.col(p).alias(f"_{p}") for p in levels],
            F.expr("share div supply").alias("whole"),
            F.expr("share % supply").alias("rest"),
        ),
        "leaves",
    )
    dealt = rows.select("doc_id", "n_tokens", *levels).join(leaves, _same(levels, "_"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = dealt.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, SLICE_DIGITS))
    dealt = materialise(dealt, "dealt")
    columns = ["doc_id", "epoch", "n_tokens", *levels]
    whole = dealt.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))

    leaf = [f"_{p}" for p in levels]
    sums = dealt.where("rest > 0").groupBy(*leaf, "_slice").agg(F.sum("n_tokens").alias("_tokens"), F.first("rest").alias("rest"))
    so_far = F.sum("_tokens").over(Window.partitionBy(*leaf).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_end", so_far).withColumn("_begin", F.col("_end") - F.col("_tokens")).where("_begin <= rest")
    sums = sums.withColumnsRenamed({c: f"s{c}" for c in leaf} | {"_slice": "s_slice", "rest": "s_rest"})
    last = dealt.where("rest > 0").join(sums, (F.col("_slice") == F.col("s_slice")) & _same(leaf, "s")).withColumn("epoch", F.col("whole"))
    inside = Window.partitionBy(*leaf, "_slice").orderBy("_order", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ending = last.where("_end > rest").withColumn("_sum", F.col("_begin") + F.sum("n_tokens").over(inside)).where("_sum <= rest")
    return whole.select(columns).union(last.where("_end <= rest").select(columns)).union(ending.select(columns))
