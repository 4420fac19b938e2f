"""Hard negatives: for an anchor and its best positives, the best rows of other labels in a window of scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm import angles
from paperloom.llm.common import numbered, python_ready
from paperloom.session import materialise

#: Rows that the references are chosen from, at most, by a seeded hash; and how many there are.
SAMPLE_ROWS, SEED, REFERENCES = 2_000, 5, 16
#: Anchors that a pass over all rows looks after; a pass broadcasts these with their angles.
BLOCK_ANCHORS = 2_048


@dataclass
class _Anchors:
    """One block of anchors as arrays."""

    ident: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, rows) -> _Anchors:
        return cls(
            np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64),
            _padded([r["vector"] for r in rows]), np.array([r["norm"] for r in rows]),
            np.array([r["angles"] for r in rows], np.float32),
        )


def _padded(vectors: list[list[int]]) -> np.ndarray:
    """Rows of whole numbers, the shorter ones ended by zeros."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), max(1, int(lengths.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.fromiter((x for v in vectors for x in v), np.int64, len(row))
    return out


def _rows_of(batch: pa.RecordBatch) -> _Anchors:
    vectors = batch["vector"]
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() == lengths.max() > 0:  # the usual case without a detour by lists
        padded = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lengths), -1)
    else:
        padded = _padded(vectors.to_pylist())
    stored = batch["angles"].flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)
    return _Anchors(batch["vec_id"].to_numpy(), batch["label"].to_numpy(), padded, batch["norm"].to_numpy(), stored)


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components that both sides have; the rest multiplies with zeros."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def whole_vectors(rows: DataFrame, vector: Column, label: Column) -> DataFrame:
    """``vec_id, label, vector`` with vector as floor(256 * x), of the rows that take part."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * 256 < angles.MAX_COMPONENT))
    taken = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(usable, F.lit(False)))
    return taken.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), scaled.cast("array<int>").alias("vector"))


def index(rows: DataFrame, count: int = REFERENCES) -> DataFrame:
    """`rows` with ``norm`` and ``angles`` to references chosen from a bounded sample, ordered by nearness."""
    python_ready(rows.sparkSession)
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    refs = angles.references(_padded([r["vector"] for r in sample]).astype(float), count) if sample else np.eye(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _padded(batch["vector"].to_pylist()).astype(float)
            norms = np.linalg.norm(vectors, axis=1)
            stored = angles.angles(*_both(vectors, refs)[:1], norms, _both(vectors, refs)[1])
            columns = [*batch.columns, pa.array(norms), pa.array(list(stored), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "norm", "angles"])

    indexed = rows.mapInArrow(run, "vec_id long, label long, vector array<int>, norm double, angles array<float>")
    nearest = F.array_min("angles")
    return materialise(indexed.sortWithinPartitions(F.array_position("angles", nearest), nearest), "indexed")


def _best_positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: _Anchors = shared.value
        best = angles.Best(len(anchors.ident), k)
        for batch in batches:
            rows = _rows_of(batch)
            for label in np.intersect1d(rows.label, anchors.label):
                a, b = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
                _, upper = angles.bounds(anchors.angles[a], anchors.norms[a], rows.angles[b], rows.norms[b])
                wanted = (upper >= best.floor[a, None]) & (anchors.ident[a, None] != rows.ident[None, b])
                score = angles.scores(*_both(anchors.vectors[a], rows.vectors[b]), wanted)
                i, j = np.nonzero(wanted & (score >= best.floor[a, None]))
                best.add(a[i], score[i, j], rows.ident[b[j]])
        group, score, ident = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(score), pa.array(ident)], names=["slot", "score", "ident"])

    return run


def _best_negatives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = shared.value  # windows per anchor, empty where low > high
        best = angles.Best(low.size, k)
        for batch in batches:
            rows = _rows_of(batch)
            lower, upper = angles.bounds(anchors.angles, anchors.norms, rows.angles, rows.norms)
            least = np.maximum(low, best.floor.reshape(low.shape))
            open_ = least <= high
            overlaps = np.zeros(lower.shape, bool)
            for p in range(low.shape[1]):
                overlaps |= open_[:, p, None] & (upper >= least[:, p, None]) & (lower <= high[:, p, None])
            overlaps &= (anchors.label[:, None] != rows.label[None, :]) & (anchors.ident[:, None] != rows.ident[None, :])
            score = angles.scores(*_both(anchors.vectors, rows.vectors), overlaps)
            for p in range(low.shape[1]):
                i, j = np.nonzero(overlaps & (score >= least[:, p, None]) & (score <= high[:, p, None]))
                best.add(i * low.shape[1] + p, score[i, j], rows.ident[j])
        slot, score, ident = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ident)], names=["slot", "score", "ident"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "ident")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    indexed: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90),
    block: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors in `indexed`.

    `indexed` is what `index` made of rows (vec_id, label, vector).  Scores are integer
    inner products; a shorter vector counts as ended by zeros.  An anchor's positives are
    its best rows of the same label, its negatives for each the best rows of another label
    with share[0] % <= score / positive score <= share[1] %; higher scores first, ties by
    vec_id.  Rows with the anchor's own vec_id are never its partners; an anchor row that
    is repeated is mined again, a repeated row of another id counts again.  Without
    anchors, or rows, nothing is found.

    Anchors are taken in blocks of a fixed number, each broadcast to two passes over all
    rows, so the work is anchors times rows, less what the bounds rule out, and no row is
    shuffled; what moves is k rows per anchor and task.
    """
    spark = indexed.sparkSession
    python_ready(spark)
    anchors = numbered(indexed.where(is_anchor), ["vec_id", F.xxhash64("vector", "label")], None, "anchors")
    anchors = anchors.withColumn("block", F.floor(F.col("_start") / block))
    columns = "slot long, score long, ident long"
    parts = []
    for number in sorted(r["block"] for r in anchors.select("block").distinct().collect()):
        here = _Anchors.of(anchors.where(F.col("block") == number).orderBy("_start").collect())
        shared = spark.sparkContext.broadcast(here)
        found = _ranked(indexed.mapInArrow(_best_positives(shared, positives), columns), positives)
        of, at = np.zeros((2, len(here.ident), positives), np.int64)
        low, high = np.ones_like(of), np.zeros_like(of)  # no window
        for r in found.collect():  # at most `positives` rows for each anchor of the block
            place, p = (r["slot"], r["rank"] - 1), r["score"]
            of[place], at[place] = r["ident"], p
            low[place], high[place] = -(-share[0] * p // 100), share[1] * p // 100
        windows = spark.sparkContext.broadcast((here, low, high))
        best = _ranked(indexed.mapInArrow(_best_negatives(windows, negatives), columns), negatives)
        names = spark.createDataFrame(
            [(k, int(here.ident[k // positives]), int(i), int(s)) for k, (i, s) in enumerate(zip(of.ravel(), at.ravel()))],
            "slot long, anchor_id long, positive_id long, positive_score long",
        )
        named = best.join(F.broadcast(names), "slot").select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("ident").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
        parts.append(materialise(named, "negatives"))
    if not parts:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return reduce(DataFrame.union, parts)
