"""Read side: tabs, facets, counts and date ranges over the slim index and user state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.dates import instant, range_label
from paperloom.functions.text import filled
from paperloom.operators.ranking import positioned

WEEK = "interval 7 days"
TABS = ("all", "weekly", "starred", "hidden")


def is_this_week(run_ts: datetime) -> Column:
    """Generated within seven days; false for a missing or unreadable time."""
    ts = F.try_to_timestamp("generated_at")
    return F.coalesce(ts >= instant(run_ts) - F.expr(WEEK), F.lit(False))


def this_week(index: DataFrame, run_ts: datetime) -> DataFrame:
    return index.where(is_this_week(run_ts))


def by_topic(index: DataFrame, topic: str | None) -> DataFrame:
    return index.where(F.col("topic") == topic) if topic else index


def visible(index: DataFrame, hidden: DataFrame) -> DataFrame:
    return index.join(hidden.select("arxiv_id"), "arxiv_id", "left_anti")


def hidden_only(index: DataFrame, hidden: DataFrame) -> DataFrame:
    return index.join(hidden.select("arxiv_id"), "arxiv_id", "left_semi")


def starred_visible_ids(stars: DataFrame, hidden: DataFrame) -> DataFrame:
    """Starred minus hidden."""
    return stars.select("arxiv_id").join(hidden.select("arxiv_id"), "arxiv_id", "left_anti").distinct()


#: Bits of ``tabs``, in the order of `TABS`.
BIT = {name: 1 << k for k, name in enumerate(TABS)}


def marked(index: DataFrame, stars: DataFrame, hidden: DataFrame, run_ts: datetime) -> DataFrame:
    """`index` with ``starred`` and ``tabs``, the bits of all tabs that show a row; one join for every view.

    A hidden paper shows in the hidden tab only, starred or not.
    """
    state = (
        stars.select("arxiv_id", F.lit(True).alias("_star"), F.lit(None).cast("boolean").alias("_hide"))
        .union(hidden.select("arxiv_id", F.lit(None).cast("boolean"), F.lit(True)))
        .groupBy("arxiv_id").agg(F.max("_star").alias("_star"), F.max("_hide").alias("_hide"))
    )
    star, hide = F.coalesce("_star", F.lit(False)), F.coalesce("_hide", F.lit(False))
    shown = (
        F.lit(BIT["all"])
        + F.when(is_this_week(run_ts), BIT["weekly"]).otherwise(0)
        + F.when(star, BIT["starred"]).otherwise(0)
    )
    rows = index.join(state, "arxiv_id", "left")
    return rows.select(*index.columns, star.alias("starred"), F.when(hide, BIT["hidden"]).otherwise(shown).alias("tabs"))


def in_tab(rows: DataFrame, name: str) -> DataFrame:
    """Rows of `marked` that one tab shows."""
    if name not in BIT:
        raise ValueError(f"unknown tab {name!r}; expected one of {TABS}")
    return rows.where(F.col("tabs").bitwiseAND(F.lit(BIT[name])) > 0)


def each_tab(rows: DataFrame) -> DataFrame:
    """Rows of `marked` once per tab that shows them, with its name as ``tab``."""
    names = F.array(*[F.when(F.col("tabs").bitwiseAND(F.lit(bit)) > 0, name) for name, bit in BIT.items()])
    return rows.withColumn("tab", F.explode(F.array_compact(names)))


def tab(index: DataFrame, stars: DataFrame, hidden: DataFrame, name: str, run_ts: datetime) -> DataFrame:
    """Rows of one tab."""
    return in_tab(marked(index, stars, hidden, run_ts), name).select(index.columns)


def facets(rows: DataFrame, *by: str) -> DataFrame:
    """Papers per topic (and `by`), blank topics left out; the label is the one of the newest row.

    A blank label falls back to the topic name.
    """
    label = F.coalesce(filled(F.col("topic_label")), F.col("topic"))
    order = F.struct(F.coalesce("generated_at", F.lit("")), F.coalesce("arxiv_id", F.lit("")))
    return (
        rows.where(filled(F.col("topic")).isNotNull())
        .groupBy(*by, "topic")
        .agg(F.max_by(label, order).alias("label"), F.count("*").alias("n"))
    )


def _by_label() -> list[Column]:
    return [F.collate("label", "UNICODE"), F.col("topic")]


def facets_sorted(rows: DataFrame) -> DataFrame:
    """Facets by label in dictionary order."""
    return facets(rows).orderBy(*_by_label())


def facet_positions(rows: DataFrame) -> DataFrame:
    """Facets with their place in that order."""
    return positioned(facets(rows), _by_label())


def tab_counts(index: DataFrame, stars: DataFrame, hidden: DataFrame, run_ts: datetime) -> DataFrame:
    """Counts on the tabs; starred and hidden count the state itself, also ids that no row has."""
    return counts(marked(index, stars, hidden, run_ts), stars, hidden)


def counts(rows: DataFrame, stars: DataFrame, hidden: DataFrame) -> DataFrame:
    """The same from rows of `marked`."""
    names = ("visible", "weekly", "starred", "hidden")

    def one(df: DataFrame, **found: Column) -> DataFrame:
        return df.agg(*[found.get(n, F.first(F.lit(0))).cast("bigint").alias(n) for n in names])

    shown = {n: F.count_if(F.col("tabs").bitwiseAND(F.lit(BIT[t])) > 0) for n, t in (("visible", "all"), ("weekly", "weekly"))}
    parts = one(rows, **shown).union(one(stars, starred=F.count("*"))).union(one(hidden, hidden=F.count("*")))
    return parts.agg(*[F.sum(n).alias(n) for n in names])


def date_range(index: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """First and last date, and the number of all matched rows, dated or not."""
    rows = index if ids is None else index.join(ids.select("arxiv_id"), "arxiv_id", "left_semi")
    date = filled(F.col("published"))
    return rows.agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("n")).withColumn(
        "label", range_label(F.col("start"), F.col("end"))
    )
