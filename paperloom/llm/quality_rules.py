"""Quality rules: a decision list learned by sequential covering, applied as a Spark expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import map_batches
from paperloom.llm.words import split_words
from paperloom.session import materialise

#: Labelled rows that the rules are learned from at most, the first by a seeded hash.
SAMPLE_ROWS, SEED = 20_000, 3
#: Documents with fewer words, or a larger percentage of repeated words, fail outright.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Candidate thresholds per feature, conditions per rule, rules, and what a rule must reach on unseen rows.
THRESHOLDS, CONDITIONS, RULES, PRECISION, COVERED = 32, 4, 12, 0.9, 5

_SYMBOL = re.compile(r"[#*$%&|<>]")

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, n_upper long, n_digits long, n_distinct long, n_ends long"

#: name -> expression over the counts; the learner's only inputs.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "distinct_ratio": "n_distinct / sqrt(greatest(n_words, 1))",
    "ending_ratio": "n_ends / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


class _Numbering(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more, the first included; and distinct words."""
    numbers = _Numbering()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(numbers)
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, place, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum()), len(numbers)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of `COUNTS`; all 0 for null."""
    text = text or ""
    words = split_words(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    repeated, distinct = repeat_words(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    spaces = int(((points == 32) | ((points >= 9) & (points <= 13))).sum())
    return (
        len(words),
        len(text) - spaces,
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(text),
        len(lines),
        int(((points >= 65) & (points <= 90)).sum()),
        int(((points >= 48) & (points <= 57)).sum()),
        distinct,
        int(((points == 46) | (points == 33) | (points == 63)).sum()),
    )


def count_texts(docs: DataFrame) -> DataFrame:
    """One row of counts per row of `docs` (doc_id, text)."""
    return map_batches(
        docs.select("doc_id", "text"),
        lambda batch: [(i, *text_counts(t)) for i, t in zip(batch["doc_id"], batch["text"])],
        COUNTS,
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, '<=' or '>', threshold)`` that marks a document as bad."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, cut in self.conditions:
            out &= x[name] <= cut if sign == "<=" else x[name] > cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & (value <= cut if sign == "<=" else value > cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {c:.6g}" for n, s, c in self.conditions)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Quantiles, each moved halfway to the next larger value that occurs."""
    distinct = np.unique(values)
    at = np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]), side="right")
    at = np.unique(at[(at > 0) & (at < len(distinct))])
    return (distinct[at - 1] + distinct[at]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the highest information gain until only bad rows are covered."""
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    for _ in range(CONDITIONS):
        p, n = int(bad[inside].sum()), int(inside.sum())
        if p == 0 or p == n:
            break
        best, before = (0.0, None, None), np.log2(p / n)
        for name, values in x.items():
            for cut in _cuts(values[inside]):
                low = inside & (values <= cut)
                n_low, p_low = int(low.sum()), int(bad[low].sum())
                for sign, pc, nc in (("<=", p_low, n_low), (">", p - p_low, n - n_low)):
                    if pc and nc < n:
                        gain = pc * (np.log2(pc / nc) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, sign, float(cut)), low if sign == "<=" else inside & ~low)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = best[2]
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop trailing conditions while (right - wrong) / covered does not fall on unseen rows."""

    def worth(r: Rule) -> float:
        covered = r.covers(x)
        n = int(covered.sum())
        return (2 * int(bad[covered].sum()) - n) / n if n else -1.0

    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows: grow on two thirds, prune on the rest, drop what is covered, again.

    Ends when a rule is no longer right often enough on the rows it was not grown on.
    One class alone, or no rows, gives no rule.
    """
    rules: list[Rule] = []
    unseen = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < RULES:
        seen_rows, unseen_rows = left & ~unseen, left & unseen
        if not bad[seen_rows].any() or bad[seen_rows].all():
            break
        rule = _grow({k: v[seen_rows] for k, v in x.items()}, bad[seen_rows])
        if not rule.conditions:
            break
        rule = _prune(rule, {k: v[unseen_rows] for k, v in x.items()}, bad[unseen_rows])
        covered = rule.covers(x) & left
        check, right = int((covered & unseen).sum()), int(bad[covered & unseen].sum())
        all_right, n = int(bad[covered].sum()), int(covered.sum())
        if n < COVERED or all_right < PRECISION * n or right < PRECISION * check:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression over the counts: true keeps."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from labelled rows; a document with several labels is bad if one says so, null labels say nothing."""
    judged = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (
        counts.join(judged.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"))
        .select("quality", "doc_id", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), *FEATURES).limit(sample_rows).toPandas()
    )
    return learn_rules({n: rows[n].to_numpy(float) for n in FEATURES}, rows["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict per row of `docs` (doc_id, text): ``..., base_failed, kept``.

    A null text has no words and fails the base like an empty one.  Texts are read once;
    rules are learned from at most `SAMPLE_ROWS` labelled rows and applied to all.
    """
    counts = materialise(count_texts(docs), "counts")
    rules = fit(counts, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision(rules))
