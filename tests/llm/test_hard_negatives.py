import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import angles
from paperloom.llm.hard_negatives import hard_negatives, index, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, slot string, norm string, angles string, score string, _start int, block int"


def mine(spark, rows, **how):
    df = spark.createDataFrame([(*r, "s", "n", "a", "c", 1, 2) for r in rows], SCHEMA)
    out = hard_negatives(index(whole_vectors(df, F.col("embedding"), F.col("label"))), F.col("vec_id") % 10 == 0, **how)
    return sorted(tuple(r) for r in out.collect())


def brute(rows, positives=5, negatives=10, low=30, high=90):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, v, label in whole:
        if i % 10:
            continue
        rated = sorted(((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in whole if j != i))
        for p, j, _ in [r for r in rated if r[2] == label][:positives]:
            fit = [r for r in rated if r[2] != label and low * -p <= 100 * -r[0] <= high * -p]
            out += [(i, j, k + 1, r[1], -p, -r[0]) for k, r in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("block", [2_048, 3])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.7).astype(float).tolist(), int(rng.integers(3))) for i in range(150)]
    want = brute(rows)
    assert mine(spark, rows, block=block) == want and len(want) > 100


def test_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i // 2, [rng.choice([0.0, 0.25, 0.5]) for _ in range(3)], rng.randrange(3)) for i in range(200)]
    rows += rows[:40] + [(10, [0.0, 0.0, 0.0], 1), (10, [0.0, 0.0, 0.0], 1)]
    assert mine(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (None, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.5, 0.4], 2), (3, [0.5, None], 1), (4, [0.5, nan], 1),
        (5, [inf, 1.0], 1), (6, None, 1), (7, [0.8, 0.4], None), (8, [], 2), (9, [0.6, 0.1, 5.0], 2), (11, [0.7], 1), (20, [-1.0, -0.5], 2),
        (30, [0.0, 0.0], 2), (40, [3e38, 0.0], 1), (12, [20_000.0, 20_000.0], 1), (50, [30_000.0, 30_000.0], 1), (13, [9_000.0, 30_000.0], 2),
    ]
    assert mine(spark, rows) == brute([r for r in rows if r[0] != 40])
    assert mine(spark, []) == [] and mine(spark, [(1, [0.5], 1)]) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    for scale in (1, 1000, 1 << 18):
        x = np.floor(rng.normal(size=(80, 9)) * scale * 256 / 9)
        x[0] = 0
        x[1] = x[2] * 2
        norms = np.linalg.norm(x, axis=1)
        refs = angles.references(x[:30], 6)
        stored = angles.angles(x, norms, refs)
        low, high = angles.bounds(stored, norms, stored, norms)
        whole = x.astype(np.int64)
        exact = whole.astype(object) @ whole.astype(object).T
        assert (low <= exact).all() and (exact <= high).all()
        assert (angles.scores(whole, whole, np.ones((80, 80), bool)) == exact).all()


def test_bounds_rule_out_far_rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 32)) * 100
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(400, 32))
    norms = np.linalg.norm(x, axis=1)
    stored = angles.angles(x, norms, angles.references(x, 8))
    low, high = angles.bounds(stored, norms, stored, norms)
    wanted = (x @ x.T) >= 0.9 * norms[:, None] ** 2
    assert ((high >= 0.9 * norms[:, None] ** 2) & ~wanted).mean() < 0.05
