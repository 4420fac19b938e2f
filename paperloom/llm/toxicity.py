"""Toxic documents by multiple-instance learning: document labels teach a score of sentences.

A document is a bag of sentences.  A sentence with known features has the probability
``sigmoid(bias + sum of weights)``, one without has none, and the document's probability
is their noisy-or, ``1 - product of (1 - p)``.  Weights are fitted to document labels
alone; afterwards the sentences' own probabilities show where the offence is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import python_ready
from paperloom.session import materialise

#: Labelled documents that the model is fitted to at most, the first by a seeded hash.
SAMPLE_DOCS, SEED = 20_000, 13
#: Hashed features, those that the model keeps, toxic documents and evidence (a likelihood ratio) that one must have.
BUCKETS, FEATURES, MIN_TOXIC, EVIDENCE = 1 << 18, 1_000, 3, 12.0
#: Lengths of the beginnings of a word that are features besides the word.
BEGINNINGS = range(4, 10)
#: Fitting: steps at most, the relative gain of 10 steps that ends it, cost of a weight's size, first bias.
STEPS, GAIN, LASSO, START_BIAS = 300, 1e-3, 0.3, -3.0
#: A sentence offends from this probability on; so does a document.
OFFENDS = 0.5
#: Words remembered per worker.
REMEMBERED = 300_000

_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    """Buckets of a lower-cased word and of its beginnings that are shorter than itself."""
    pieces = [f"^{word}$", *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))]
    return {xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in pieces}


class _Known(dict):
    """word -> its features among `kept` as positions (all buckets where `kept` is None), remembered per word."""

    def __init__(self, kept: dict[int, int] | None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        value = tuple(found if self.kept is None else (self.kept[f] for f in found if f in self.kept))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def bag(text: str | None, known: _Known) -> Iterator[tuple[int, int, frozenset[int]]]:
    """``start, end, features`` of every sentence that has known features."""
    for sentence in _SENTENCE.finditer(text or ""):
        features: set[int] = set()
        for word in _WORD.findall(sentence[0].lower()):
            if there := known[word]:
                features.update(there)
        if features:
            yield sentence.start(), sentence.end(), frozenset(features)


@dataclass
class Model:
    """Weights of the kept buckets; without any, every score is 0."""

    buckets: list[int]
    weights: np.ndarray
    bias: float

    def known(self) -> _Known:
        return _Known({b: k for k, b in enumerate(self.buckets)})

    def sentence(self, features: frozenset[int]) -> float:
        z = self.bias + float(sum(self.weights[k] for k in sorted(features)))
        return 1 / (1 + np.exp(-z)) if z > -500 else 0.0

    def spans(self, text: str | None, known: _Known) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and ``start, end, probability`` of its sentences with known features."""
        found = [(start, end, self.sentence(features)) for start, end, features in bag(text, known)]
        rest = np.prod([1 - p for *_, p in found]) if found else 1.0
        return float(min(1.0, max(0.0, 1 - rest))), found


def fit_bags(bags: list[tuple[int, list[tuple[list[int], int]]]], n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias for bags of (label, [(features, how often)]).

    Proximal gradient steps on the noisy-or's likelihood plus the cost of the weights,
    each as long as the quadratic bound allows; weights that explain little stay 0.
    """
    weights, bias = np.zeros(n_features), START_BIAS
    bags = [b for b in bags if b[1]]
    labels = np.array([y for y, _ in bags], float)
    if not n_features or not labels.any() or labels.all():
        return weights, bias
    of = np.repeat(np.arange(len(bags)), [len(s) for _, s in bags])
    often = np.array([n for _, s in bags for _, n in s], float)
    sizes = np.array([len(f) for _, s in bags for f, _ in s])
    flat = np.array([f for _, s in bags for fs, _ in s for f in fs], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def loss(weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        z = np.clip(bias + np.bincount(owner, weights[flat], len(sizes)), -30, 30)
        silent = np.bincount(of, -often * np.logaddexp(0, z), len(bags))  # log probability that no sentence offends
        heard = np.maximum(-np.expm1(silent), 1e-12)
        pull = np.where(labels == 1, -np.exp(silent) / heard, 1.0)
        g = pull[of] * often / (1 + np.exp(-z))
        return float(np.where(labels == 1, -np.log(heard), -silent).sum()), np.bincount(flat, g[owner], n_features), float(g.sum())

    now, slope, tilt = loss(weights, bias)
    length, costs = 1e-2, []
    for _ in range(STEPS):
        while True:
            moved = weights - length * slope
            moved = np.sign(moved) * np.maximum(np.abs(moved) - length * LASSO, 0)
            shifted = bias - 0.1 * length * tilt
            value, next_slope, next_tilt = loss(moved, shifted)
            d, e = moved - weights, shifted - bias
            if length < 1e-6 or value <= now + slope @ d + tilt * e + (d @ d + 10 * e * e) / (2 * length) + 1e-9:
                break
            length /= 2
        weights, bias, now, slope, tilt = moved, shifted, value, next_slope, next_tilt
        length *= 1.3
        costs.append(now + LASSO * float(np.abs(weights).sum()))
        if len(costs) > 10 and costs[-11] - costs[-1] < GAIN * costs[-1]:
            break
    return weights, bias


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without and with the label that hold each bucket."""
    known, counts = _Known(None), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            found = {w for s in _SENTENCE.finditer(text or "") for w in _WORD.findall(s[0].lower())}
            held = np.fromiter({f for w in found for f in known[w]}, np.int64)
            counts[int(toxic > 0), held] += 1
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "clean", "toxic"])


def _evidence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The likelihood ratio of a feature and the label against independence."""
    n, held = n_toxic + n_clean, toxic + clean

    def part(seen: Column, rows: Column, share: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (rows * share))).otherwise(0.0)

    both = part(toxic, held, n_toxic) + part(clean, held, n_clean)
    return 2 * (both + part(n_toxic - toxic, n - held, n_toxic) + part(n_clean - clean, n - held, n_clean))


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int) -> DataFrame:
    """``text, toxic`` of at most `sample_docs` labelled documents, one row a doc_id."""
    judged = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
    judged = judged.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    judged = judged.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(judged), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labels (doc_id, toxic) where `usable` holds; several labels of a document: the worst counts."""
    python_ready(docs.sparkSession)
    sample = materialise(_sample(docs, labels, usable, sample_docs), "labelled")
    sizes = {r["toxic"] > 0: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model([], np.empty(0), START_BIAS)
    counts = sample.mapInArrow(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    kept = (
        counts.withColumn("evidence", _evidence(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
        .where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic) & (F.col("evidence") > EVIDENCE))
        .orderBy(F.desc("evidence"), "bucket").limit(FEATURES).select("bucket").collect()
    )
    buckets = [r["bucket"] for r in kept]
    places = {b: k for k, b in enumerate(buckets)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(places)
        for batch in batches:
            out = [Counter(f for *_, f in bag(text, known)) for text in batch["text"].to_pylist()]
            sentences = [[{"features": sorted(f), "often": n} for f, n in sorted(c.items(), key=lambda x: sorted(x[0]))] for c in out]
            yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "sentences": sentences}, schema=shape)

    shape = pa.schema(
        [("toxic", pa.int32()), ("sentences", pa.list_(pa.struct([("features", pa.list_(pa.int32())), ("often", pa.int64())])))]
    )
    rows = sample.mapInArrow(bags, "toxic int, sentences array<struct<features: array<int>, often: bigint>>").collect()
    gathered = [(int(r["toxic"] > 0), [(s["features"], s["often"]) for s in r["sentences"]]) for r in rows]
    gathered.sort()  # whatever order the tasks ended in
    return Model(buckets, *fit_bags(gathered, len(buckets)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text): ``doc_id, score, predicted, offending``.

    `offending` lists ``start, end, score`` (code points, end exclusive) of the sentences
    that offend by themselves.  A null or empty text, and one without known features,
    scores 0.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known()
        for batch in batches:
            results = [shared.value.spans(text, known) for text in batch["text"].to_pylist()]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in found if p >= OFFENDS] for _, found in results]
            total = [p for p, _ in results]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(total, pa.float64()), pa.array([int(p >= OFFENDS) for p in total], pa.int32()), pa.array(spans, offence)],
                names=["doc_id", "score", "predicted", "offending"],
            )

    offence = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = "doc_id long, score double, predicted int, offending array<struct<start: bigint, end: bigint, score: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` per row of `docs` (doc_id, text).

    Labels of held-out documents, those whose crc32(doc_id as text) mod `folds` is
    `held_fold`, are not learned from.  A null doc_id counts as empty text.  Repeated
    rows are scored alike; of rows that share a doc_id one text is learned from.  Null labels
    say nothing; without labels of both kinds every score is 0.
    """

    def held(of: str) -> Column:
        return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % folds == held_fold

    model = fit(docs, labels, ~held("doc_id"), sample_docs)
    return score(docs, model).select("doc_id", held("doc_id").alias("held_out"), "score", "predicted", "offending")
