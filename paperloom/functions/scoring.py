"""Keyword scores, weighted totals and the offline dimension scorer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from paperloom.config import EXPERIMENT_WORDS, NOVELTY_WORDS, Dimension
from paperloom.functions.replies import clamp
from paperloom.functions.text import let


def hits(words: Column, text: Column) -> Column:
    """How many of `words` occur in lower-case `text` as substrings."""
    return F.size(F.filter(words, lambda w: F.contains(text, F.lower(w))))


def keyword_score(words: Column, text: Column) -> Column:
    """Share of keywords found; 0.5 for an empty list."""
    return F.when(F.size(words) == 0, F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), hits(words, text).cast("double") / F.greatest(F.lit(1), F.size(words)))
    )


def hint_score(words: Sequence[str], text: Column) -> Column:
    """Found hint words over three, at most one."""
    found = F.lit(0)
    for word in words:
        found = found + F.when(F.contains(text, F.lit(word)), 1).otherwise(0)
    return F.least(F.lit(1.0), found.cast("double") / 3.0)


def offline_scores(
    dimensions: Sequence[Dimension],
    text: Column,
    include: Column,
    categories: Column,
    interest: Column,
    novelty_words: Sequence[str] = NOVELTY_WORDS,
    experiment_words: Sequence[str] = EXPERIMENT_WORDS,
    overrides: Mapping[str, Column] | None = None,
) -> Column:
    """``array<struct(name, weight, value)>`` in configuration order.

    `text` is the lower-case title and abstract.  `overrides` maps a dimension name
    to its own 0-100 column; a dimension nobody knows scores 50.
    """
    rules = {
        "topic_alignment": lambda: keyword_score(include, text) * 70.0
        + keyword_score(categories, text) * 30.0,
        "methodology_fit": lambda: let(
            F.concat(text, F.lit(" "), F.lower(interest)), lambda both: keyword_score(include, both) * 80.0
        ),
        "novelty": lambda: hint_score(novelty_words, text) * 60.0 + 40.0,
        "experiment_coverage": lambda: hint_score(experiment_words, text) * 70.0 + 30.0,
    }
    parts = []
    for dim in dimensions:
        if overrides and dim.name in overrides:
            raw = overrides[dim.name]
        else:
            raw = rules[dim.name]() if dim.name in rules else F.lit(50.0)
        parts.append(
            F.struct(
                F.lit(dim.name).alias("name"),
                F.lit(float(dim.weight)).alias("weight"),
                (clamp(raw, 0.0, 100.0) / 100.0).alias("value"),
            )
        )
    return F.array(*parts)


def total_score(scores: Column) -> Column:
    """Weighted sum, added in list order so that ties at a threshold are stable."""
    return F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["weight"] * s["value"])


def total_weight(scores: Column) -> Column:
    weight = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s["weight"])
    return F.when(weight == 0.0, F.lit(1.0)).otherwise(weight)


def normalised_score(scores: Column) -> Column:
    """Weighted mean on a 0-100 scale."""
    return total_score(scores) / total_weight(scores) * 100.0


def passes(scores: Column, threshold: float) -> Column:
    return normalised_score(scores) >= F.lit(float(threshold))


def top_dimension(scores: Column) -> Column:
    """Dimension with the largest weighted value, the earliest on a tie."""
    ranked = F.transform(
        scores,
        lambda s, i: F.struct((s["weight"] * s["value"]).alias("wv"), (-i).alias("neg_pos"), s.alias("dim")),
    )
    return F.array_max(ranked)["dim"]


def recommendation(scores: Column, findings: Column, topic_label: Column) -> Column:
    """One sentence on the strongest dimension plus the first confident finding."""
    sure = F.filter(findings, lambda f: f["confidence"] > 0.6)
    insight = F.substring(F.get(sure, 0)["answer"], 1, 200)
    top = top_dimension(scores)
    lead = F.concat(
        F.lit("This paper scores high in the **"),
        top["name"],
        F.lit("** dimension ("),
        one_decimal(top["value"] * 100.0),
        F.lit("/100), highly aligned with your research interests in "),
        topic_label,
        F.lit("."),
    )
    tail = F.when(F.coalesce(insight, F.lit("")) != "", F.concat(F.lit(" "), insight, F.lit("...")))
    general = F.concat(
        F.lit("This paper is relevant to your research direction in "),
        topic_label,
        F.lit(", recommended for further reading."),
    )
    return F.when(top.isNotNull(), F.concat(lead, F.coalesce(tail, F.lit("")))).otherwise(general)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, halves to even."""
    return F.format_string("%.1f", F.bround(value, 1))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.bround(value, 2))
