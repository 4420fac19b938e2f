import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm.components import connected_components
from paperloom.llm.near_dedup import near_dedup
from paperloom.llm.sketch import band_keys, sketch
from paperloom.llm.words import mix, shingle_set
from tests.llm.data import AWKWARD, frame, words


def brute(rows, k, percent):
    """Smallest reachable id per row, by comparing all pairs of word-tuple sets."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    lowest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), row[0]), row[0])
    return sorted((str(r[0]), len(sets[i]), str(lowest.get(find(i)))) for i, r in enumerate(rows))


def run(spark, rows, k=4, percent=80):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup(frame(spark, rows), k, percent).collect())


def test_families_against_all_pairs(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(6):
        base = words(rng, 120)
        for _ in range(30):  # copies at every distance around the threshold, chains among them
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(9999)}"
            rows.append((i, " ".join(text), "en", "s"))
            i += 1
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 4, 80)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    from paperloom.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK_SHINGLES", 500)
    rng = random.Random(9)
    base = words(rng, 150)
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randrange(3, 8)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(text), "en", "s"))
    assert run(spark, rows) == brute(rows, 4, 80)


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD, 4, 80)
    kept = {r.doc_id: r.kept for r in near_dedup(frame(spark, AWKWARD), 4).collect()}
    assert kept[None] and kept[1] and kept[2] and kept[6] and not kept[7]
    assert near_dedup(frame(spark, []), 4).collect() == []


def test_sketch_fills_and_estimates():
    for n in (1, 2, 7, 100, 5000):
        s = sketch(mix(np.arange(n, dtype=np.uint64)), 128)
        assert (s != np.uint64(2**64 - 1)).all()
    a, b = mix(np.arange(0, 900, dtype=np.uint64)), mix(np.arange(100, 1000, dtype=np.uint64))
    agree = (sketch(a, 1024) == sketch(b, 1024)).mean()
    assert abs(agree - 0.8) < 0.05
    assert len(set(band_keys(sketch(a, 128), 32).tolist())) == 32


def test_shingles_lower_only_ascii():
    assert len(shingle_set("A b C d E", 4)) == 2
    assert shingle_set("ÄB c d e", 4).tolist() == shingle_set("Äb C D E", 4).tolist() != shingle_set("äb c d e", 4).tolist()


def test_components_of_a_long_path(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("a", "b"), ("b", "b")]
    found = dict(connected_components(spark.createDataFrame(edges, "u string, v string")).collect())
    assert {found[f"{i:04d}"] for i in range(61)} == {"0000"} and found["b"] == "a"
    assert connected_components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_rows_without_an_id_are_linked(spark):
    rng = random.Random(12)
    base = words(rng, 80, 10**9)
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    rows = [(None, near(40)), (5, " ".join(base)), (None, near(79)), (None, near(79)), (6, "alone " + " ".join(words(rng, 50, 10**9))), (None, "x y")]
    rows = [(i, t, "en", "s") for i, t in rows]
    assert run(spark, rows) == brute(rows, 4, 80)
    found = near_dedup(frame(spark, rows), 4, 80).collect()
    assert sorted(str(r.component_id) for r in found) == ["5", "5", "5", "5", "6", "None"]
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(str(r.component_id) for r in near_dedup(named, 4, 80).collect()) == ["None", "d5", "d5", "d5", "d5", "d6"]
