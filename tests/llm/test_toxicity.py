import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm.toxicity import START_BIAS, Model, fit, fit_bags, score, toxicity, word_features
from tests.llm.data import AWKWARD, frame

LABELS = "doc_id long, quality int, toxic int, text string, score string"
BAD = ["grobnak", "flimzor", "quastel"]


def corpus(rng, n):
    """Documents of clean sentences; toxic ones hold a sentence or two with a bad stem."""
    docs, labels, bad = [], [], {}
    for i in range(n):
        sentences = [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = rng.random() < 0.2
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(BAD)}{rng.choice(['', 'en', 'ish', 's'])} {rng.choice(BAD).upper()}"
            bad[i] = k
        docs.append((i, ". ".join(sentences) + ".", "en", "s"))
        labels.append((i, 1, int(toxic), "clash", "clash"))
    return docs, labels, bad


def test_held_out_documents_and_sentences(spark):
    docs, labels, bad = corpus(random.Random(1), 600)
    found = toxicity(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 600
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id in bad)
        if r.doc_id in bad:  # the sentence that offends is the one that was made so
            text = docs[r.doc_id][1]
            assert [text[:s.start].count(".") for s in r.offending] == [bad[r.doc_id]]


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels, _ = corpus(random.Random(2), 300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, a, b) for i, q, t, a, b in labels]
    one, two = (toxicity(frame(spark, docs), spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_noisy_or_by_hand():
    model = Model([0, 1], np.array([2.0, -1.0]), -1.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    assert np.isclose(model.sentence(frozenset([0])), p(1.0)) and np.isclose(model.sentence(frozenset([0, 1])), p(0.0))
    known = dict.fromkeys(word_features("bad"), 0)
    model = Model(list(known), np.array([2.0]), -1.0)
    total, spans = model.spans("One bad. Two! bad bad\nnone", model.known())
    assert [(s, e) for s, e, _ in spans] == [(0, 7), (13, 21)]
    assert np.isclose(total, 1 - (1 - p(1.0)) ** 2)


def test_fit_finds_the_telling_feature():
    rng = random.Random(3)
    bags = []
    for _ in range(300):
        y = int(rng.random() < 0.3)
        bags.append((y, [([rng.choice([1, 2, 3])], rng.randrange(1, 4)) for _ in range(4)] + [([0, 1], 1)] * y))
    weights, bias = fit_bags(bags, 4)
    assert weights[0] > 3 and np.abs(weights[1:]).max() < 1 and bias < -2
    assert fit_bags([], 0)[1] == START_BIAS and fit_bags([(1, [([0], 1)])], 1)[0].tolist() == [0]


def test_awkward_rows(spark):
    docs, labels, _ = corpus(random.Random(4), 200)
    rows = [*AWKWARD, *[(i + 100, *r) for i, *r in docs]]
    marks = [(i + 100, q, t, a, b) for i, q, t, a, b in labels]
    marks += [(None, 1, 1, "x", "x"), (101, 1, None, "x", "x"), (9_999, 0, 1, "x", "x"), (102, 1, 1, "x", "x"), (102, 1, 0, "x", "x")]
    found = toxicity(frame(spark, rows), spark.createDataFrame(marks, LABELS)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(r.score == 0 and r.offending == [] for r in found if r.doc_id in (None, 1, 2, 3))
    assert next(r.held_out for r in found if r.doc_id is None)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity(frame(spark, rows), none).collect()} == {0.0}
    assert toxicity(frame(spark, []), none).collect() == []
    one_class = spark.createDataFrame([(i, 1, 0, "x", "x") for i in range(100, 150)], LABELS)
    assert fit(frame(spark, rows), one_class, F.lit(True)).buckets == []
    assert score(frame(spark, AWKWARD), Model([], np.empty(0), 0.0)).count() == len(AWKWARD)
