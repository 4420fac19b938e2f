"""Keeping costly expressions from being evaluated more than once.

Catalyst moves filters below projections by repeating the projected expression, and a
plain ``explode`` adds such a filter on its array.  That is right for cheap columns;
for text matching, HTML or JSON it doubles the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but later filters and projections only see the result.

    The value passes through a one-element generator, which filters do not cross.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def explode_rows(df: DataFrame, array: Column, name: str, keep: Sequence[str | Column] = ("*",)) -> DataFrame:
    """One row per array element, none for an empty array, evaluating the array once."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column, pos: str, name: str, keep: Sequence[str | Column]) -> DataFrame:
    """The same with the element's position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
