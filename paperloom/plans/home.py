"""The reading list: rows, facets, counts and dates of one tab."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from paperloom.operators import analyses as A
from paperloom.operators import views as V
from paperloom.session import materialise


@dataclass(frozen=True)
class Home:
    rows: DataFrame
    facets: DataFrame
    counts: DataFrame
    dates: DataFrame


def home(
    index: DataFrame,
    stars: DataFrame,
    hidden: DataFrame,
    run_ts: datetime,
    tab: str = "all",
    topic: str | None = None,
) -> Home:
    """Facets come before the topic choice, so they say what a choice would show.

    Index and state are met once, in the shared folder; every part reads that.
    """
    marked = materialise(V.marked(index, stars, hidden, run_ts), "marked")
    before = V.in_tab(marked, tab)
    rows = V.by_topic(before, topic)
    return Home(
        rows=rows.drop("tabs").orderBy(*A.newest_first()),
        facets=V.facets_sorted(before),
        counts=V.counts(marked, stars, hidden),
        dates=V.date_range(rows),
    )
