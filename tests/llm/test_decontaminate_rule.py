import random

import numpy as np

from paperloom.llm.decontaminate import MIN_WORDS, best_overlap
from tests.llm.data import words
from tests.llm.test_decontaminate import run


def by_definition(same, least):
    """Length and equal words of the longest stretch, from all pairs of ends."""
    best = (0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            matched = sum(same[i:j])
            if same[i] and same[j - 1] and 5 * matched >= 4 * (j - i) and matched >= least:
                best = max(best, (j - i, matched))
    return best


def test_longest_stretch_against_the_definition():
    rng = random.Random(7)
    for _ in range(1500):
        share = rng.choice([0.3, 0.7, 0.8, 0.9, 1])
        same = [rng.random() < share for _ in range(rng.randrange(40))]
        least = rng.choice([5, 6, 7, MIN_WORDS])
        begin, end, matched = best_overlap(np.array(same, bool), least)
        assert (end - begin, matched) == by_definition(same, least), (same, least)


def test_overlaps_with_substitutions(spark):
    rng = random.Random(8)
    a, b, c = words(rng, 12, 10**9), words(rng, 10, 10**9), words(rng, 50, 10**9)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "only seven words are in this item")]
    a[4] = b[4] = "other"
    c[4::5] = ["other"] * 10
    docs = [(i, f"before {' '.join(t)} after", "en", "s") for i, t in enumerate([a, b, c, "only seven words are in that item".split()])]
    # the third passage ends with a changed word; a shorter item needs all its words
    assert run(spark, docs, items) == {(0, 1): (12, 11), (1, 2): (10, 9), (2, 3): (49, 40)}
