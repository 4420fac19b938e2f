import random
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import language_id, quality_rules
from paperloom.llm.queries import op1_quality_rules, op2_hyperdimensional_language
from tests.llm.data import AWKWARD, frame

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op2_hyperdimensional_language(spark, SF).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.n_chars > 20]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_matches_plain_vectors(spark):
    """Spark's bundles equal vectors built letter by letter."""
    texts = [("en", "The cat sat, on a mat."), ("fr", "Été à la plage"), ("en", "zz top")]

    def plain(text):
        padded = re.sub(r"[^\w]|_|\d", " ", text.lower())
        points = [0] + [ord(c) if c.isalpha() else 0 for c in padded] + [0]
        points = [p for i, p in enumerate(points) if p or i == 0 or points[i - 1]]
        total = np.zeros(language_id.DIMENSION)
        for a, b, c in zip(points, points[1:], points[2:]):
            v = [language_id.letter_vector(x).astype(float) for x in (a, b, c)]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    docs = frame(spark, [(i, t, lang, "s") for i, (lang, t) in enumerate(texts)])
    learned = language_id.learn(docs)
    want = plain(texts[0][1]) + plain(texts[2][1])
    assert np.allclose(learned["en"], want / np.linalg.norm(want)) and set(learned) == {"en", "fr"}
    long = "abc déf " * 300_000  # several blocks
    codes, counts = language_id.ngrams(long)
    one = dict(zip(*(x.tolist() for x in language_id.ngrams("abc déf abc "))))
    assert counts.sum() == 2_400_001 - 2 and set(codes.tolist()) == set(one)


def test_bundles_of_shared_and_of_scattered_letters(monkeypatch):
    """Summing last letters first gives what multiplying every n-gram gives, and fills no large empty matrix."""

    def plain(codes, counts):
        total = np.zeros(language_id.DIMENSION)
        for code, count in zip(codes.tolist(), counts.tolist()):
            v = [language_id.letter_vector((code >> s) & 0x1FFFFF).astype(float) for s in (42, 21, 0)]
            total += count * np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    scattered = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(400))  # hardly a letter twice
    for text in ("the cat sat on the mat, the cat is fat", "été à la plage " * 9, scattered, "a"):
        codes, counts = language_id.ngrams(text)
        want = plain(codes, counts)
        assert np.array_equal(language_id.bundle(codes, counts), want)
        for fullness in (0, 10**9):
            monkeypatch.setattr(language_id, "FULLNESS", fullness)
            assert np.array_equal(language_id.bundle(codes, counts), want)
        monkeypatch.undo()


def test_language_awkward_rows(spark):
    out = language_id.language_id(frame(spark, AWKWARD)).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert not by[None].held_out
    assert language_id.language_id(frame(spark, [])).collect() == []
    unknown = language_id.language_id(frame(spark, [(1, "words", None, "s")])).collect()
    assert unknown[0].lang_pred == "und"
    kept = language_id.keep_known(frame(spark, AWKWARD), language_id.learn(frame(spark, AWKWARD)), 0.0)
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} >= {None, 4, 6, 7}


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_counts_against_plain_python():
    rng = random.Random(1)
    texts = ["", None, "a b c a b c", "x\n\nx\n x\ny", "a a a a", "a\u00a0b\x85c #|<\n\u3000\n\u3000", "a b c"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(50)]
    for t in texts:
        assert quality_rules.text_counts(t)[:5] == slow_counts(t)


def test_rules_on_given_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_rules_expression_equals_rules(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x = {f: rng.random(n) for f in quality_rules.FEATURES}
    bad = (x["symbol_ratio"] > 0.7) & (x["word_length"] <= 0.5) | (x["repeat_ratio"] > 0.9)
    rules = quality_rules.learn_rules(x, bad)
    found = np.zeros(n, bool)
    for r in rules:
        found |= r.covers(x)
    assert (found == bad).mean() > 0.98 and len(rules) >= 2
    assert quality_rules.learn_rules(x, np.zeros(n, bool)) == [] == quality_rules.learn_rules({k: v[:0] for k, v in x.items()}, bad[:0])
    rule = quality_rules.Rule((("n_words", ">", 2.0), ("symbol_ratio", "<=", 0.5)))
    counts = quality_rules.count_texts(frame(spark, [(1, "a b c", "en", "s"), (2, "# # # a", "en", "s"), (3, "a", "en", "s")]))
    kept = {r.doc_id: r.kept for r in counts.select("doc_id", quality_rules.decision([rule]).alias("kept")).collect()}
    assert kept == {1: False, 2: True, 3: True}
    assert spark.range(1).select(quality_rules.decision([])).first()[0] is True


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(frame(spark, AWKWARD), labels).collect()
    assert len(out) == len(AWKWARD) and all(r.base_failed and not r.kept for r in out)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(frame(spark, []), empty).collect() == []
    assert op1_quality_rules(spark, SF).where(F.col("kept") & F.col("base_failed")).count() == 0
