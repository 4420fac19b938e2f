"""Timestamps, date labels and window splitting.  "Now" is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# Accepted date formats and the compact bound format.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d'T'H:m", "yyyy-M-d'T'H:m:s")
COMPACT_FORMAT = "yyyyMMddHHmm"


def instant(moment: datetime) -> Column:
    """A driver-side time as a literal, read in the session's time zone (UTC)."""
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")


def tolerant_timestamp(text: Column, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), default)


def parse_date(text: Column) -> Column:
    """Three accepted spellings, null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS])


def compact(ts: Column) -> Column:
    return F.date_format(ts, COMPACT_FORMAT)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def split_windows(start: Column, end: Column, days: int) -> Column:
    """Array of ``struct(window_idx, win_start, win_end)``; the last one may be short.

    An empty range gives one window.
    """
    step = F.expr(f"interval {max(1, int(days))} days")
    starts = F.when(
        start < end,
        F.filter(F.sequence(start, end, step), lambda s: s < end),
    ).otherwise(F.array(start))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.cast("int").alias("window_idx"),
            s.alias("win_start"),
            F.when(start < end, F.least(s + step, end)).otherwise(end).alias("win_end"),
        ),
    )


def windows_at(ts: Column, start: datetime, end: datetime, days: int) -> Column:
    """Array of the windows of `split_windows` that hold a time between `start` and `end`.

    Both ends of a window count, so a time on a shared bound is in two.  Found by
    arithmetic: a row does the same work however many windows there are.
    """
    micro = timedelta(microseconds=1)
    step = timedelta(days=max(1, int(days)))
    last = max(0, -((start - end) // step) - 1)
    offset = F.unix_micros(ts) - F.unix_micros(instant(start))
    rest = F.pmod(offset, F.lit(step // micro))
    index = ((offset - rest) / F.lit(step // micro)).cast("int")
    hits = F.array_compact(F.array(F.when((rest == 0) & (index > 0), index - 1), F.when(index <= last, index)))
    width = F.make_dt_interval(days=F.lit(step.days))
    return F.transform(
        hits,
        lambda i: F.struct(
            i.alias("window_idx"),
            (instant(start) + width * i).alias("win_start"),
            F.least(instant(start) + width * (i + 1), instant(end)).alias("win_end"),
        ),
    )


def range_label(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() | end.isNull(), F.lit(""))
        .when(start == end, F.concat(F.lit("（"), start, F.lit("）")))
        .otherwise(F.concat(F.lit("（"), start, F.lit(" — "), end, F.lit("）")))
    )
