"""Gradient-boosted trees for yes or no, small enough to travel with a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paperloom.llm.common import map_batches, python_ready
from paperloom.session import materialise

#: Gradients are added up as whole multiples of this part of one, so sums do not depend on how rows are dealt.
PARTS = 1 << 30
#: Distinct examples that the driver adds up itself; more are added up by Spark, for the same trees.
LOCAL_ROWS = 20_000
#: Parts of the score's range in which rows are put in order on their own.
SLICES = 4096

Node = tuple[int, float, float]


class BoostedTrees:
    """Second-order boosting of shallow trees on the logistic loss, with quantile thresholds."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[list[Node]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [self._cuts(x[:, k]) for k in range(x.shape[1])]
        rows = binned(x, cuts), y, np.ones(len(y), np.int64)
        return self.boost(cuts, float(y.mean()), lambda tree, nodes: self.sums(tree, nodes, *rows))

    def fit_table(self, rows: DataFrame, local_rows: int = LOCAL_ROWS) -> BoostedTrees:
        """The same from all rows of ``x array<double>, y double, n long``, each standing for `n` examples.

        Rows that fall into the same bins are one.  Spark adds up every level of every
        tree; the driver gets the sums of the nodes.  Up to `local_rows` different rows
        are added up by the driver itself.
        """
        cuts = self._table_cuts(rows)
        names = "bins array<tinyint>, y double, n long"

        def run(batch):
            bins = binned(np.array(batch["x"]), cuts).tolist() if batch["x"] else []
            return list(zip(bins, batch["y"], batch["n"]))

        table = map_batches(rows.select("x", "y", "n"), run, names).groupBy("bins", "y").agg(F.sum("n").alias("n"))
        table = materialise(table, "examples")
        size, n, right = table.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
        if size > local_rows:
            return self.boost(cuts, right / n, lambda tree, nodes: self._table_sums(table, len(cuts), tree, nodes))
        found = table.toPandas()
        held = np.stack(found["bins"].to_numpy()), found["y"].to_numpy(float), found["n"].to_numpy(np.int64)
        return self.boost(cuts, right / n, lambda tree, nodes: self.sums(tree, nodes, *held))

    def boost(self, cuts: list[np.ndarray], share: float, sums: Callable[[list[Node], list[int]], np.ndarray]) -> BoostedTrees:
        """Grow all trees level by level; `sums` gives a level's `sums` over all rows.

        Until the end the cuts of nodes are numbers of bins.
        """
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.bias, self.trees = float(np.log(share / (1 - share))), []
        for _ in range(self.rounds):
            self.trees.append(self._grow(cuts, sums))
        self.trees = [[(k, float(cuts[k][int(at)]) if k >= 0 else 0.0, v) for k, at, v in tree] for tree in self.trees]
        return self

    def sums(self, tree: list[Node], nodes: list[int], bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gradients and curvatures, in `PARTS`, of binned rows by open node of the growing tree, feature and bin."""
        p = self.predict(bins)
        at = self._place(tree, bins)
        spot = np.full(len(tree), -1)
        spot[nodes] = np.arange(len(nodes))
        inside = spot[at] >= 0
        bins, n, p, y, at = bins[inside], n[inside], p[inside], y[inside], spot[at[inside]]
        out = np.zeros((2, len(nodes) * bins.shape[1] * self.bins), np.int64)
        cell = ((at[:, None] * bins.shape[1] + np.arange(bins.shape[1])) * self.bins + bins).ravel()
        for total, value in zip(out, (p - y, p * (1 - p))):
            np.add.at(total, cell, np.repeat(np.rint(value * PARTS).astype(np.int64) * n, bins.shape[1]))
        return out.reshape(2, len(nodes), bins.shape[1], self.bins)

    def _table_sums(self, table: DataFrame, features: int, tree: list[Node], nodes: list[int]) -> np.ndarray:
        python_ready(table.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(nodes), features, self.bins), np.int64)
            for batch in batches:
                bins, y, n = (batch.column(name) for name in ("bins", "y", "n"))
                total += self.sums(tree, nodes, bins.flatten().to_numpy().reshape(-1, features), y.to_numpy(), n.to_numpy())
            flat = total.reshape(2, -1)
            cells = np.flatnonzero(flat.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(x[cells]) for x in flat)], ["cell", "g", "h"])

        out = np.zeros((2, len(nodes) * features * self.bins), np.int64)
        found = table.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g"), F.sum("h"))
        for cell, g, h in found.collect():  # at most nodes x features x bins
            out[:, cell] = g, h
        return out.reshape(2, len(nodes), features, self.bins)

    def _table_cuts(self, rows: DataFrame) -> list[np.ndarray]:
        """The cuts of `_cuts` from all rows: values are counted and ranked by Spark, per feature `bins` of them come here."""
        total, features = rows.agg(F.sum("n"), F.max(F.size("x"))).first()
        ranks = F.array(*[F.lit(int(r)) for r in sorted(set(np.rint(np.linspace(0, 1, self.bins) * (total - 1)).tolist()))])
        values = rows.select(F.posexplode("x").alias("k", "v"), "n").groupBy("k", "v").agg(F.sum("n").alias("n"))
        until = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        picked = values.withColumn("until", until).where(
            F.exists(ranks, lambda r: (r < F.col("until")) & (r >= F.col("until") - F.col("n")))
        )
        by: dict[int, list[float]] = {}
        for k, v in picked.select("k", "v").collect():
            by.setdefault(k, []).append(v)
        return [_between(np.array(sorted(by[k]))) for k in range(features)]

    def _cuts(self, column: np.ndarray) -> np.ndarray:
        """Halfway between neighbouring values: a row goes left where it is below."""
        return _between(np.unique(np.quantile(column, np.linspace(0, 1, self.bins), method="nearest")))

    def _grow(self, cuts: list[np.ndarray], sums: Callable[[list[Node], list[int]], np.ndarray]) -> list[Node]:
        """Nodes in heap order: (feature, cut, value); feature -1 marks a leaf."""
        tree: list[Node] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        level = [0]
        for _ in range(self.depth):
            if not level:
                break
            below = []
            for node, g, h in zip(level, *(sums(tree, level) / PARTS)):
                gs, hs = g[0].sum(), h[0].sum()
                tree[node] = (-1, 0.0, self._value(gs, hs))
                best, choice = 1e-6, None
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl, hl = np.cumsum(g[k])[: len(c)], np.cumsum(h[k])[: len(c)]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, choice = float(gain[at]), (k, at, gl[at], hl[at])
                if choice:
                    k, at, gl, hl = choice
                    tree[node] = (k, float(at), 0.0)
                    tree[2 * node + 1] = (-1, 0.0, self._value(gl, hl))
                    tree[2 * node + 2] = (-1, 0.0, self._value(gs - gl, hs - hl))
                    below += [2 * node + 1, 2 * node + 2]
            level = below
        return tree

    def _value(self, g: float, h: float) -> float:
        return float(-self.rate * g / (h + self.ridge))

    def _place(self, tree: list[Node], x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to."""
        feature, cut = np.array([n[0] for n in tree]), np.array([n[1] for n in tree])
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            k = feature[at]
            inner = k >= 0
            right = x[np.arange(len(x)), np.maximum(k, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes per row."""
        margin = np.full(len(x), self.bias)
        for tree in self.trees:
            margin += np.array([n[2] for n in tree])[self._place(tree, x)]
        return 1 / (1 + np.exp(-margin))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Per value the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], axis=1)


def _between(values: np.ndarray) -> np.ndarray:
    return (values[1:] + values[:-1]) / 2


def threshold_for(score: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The lowest score from which on at least `precision` of the rows are true; 2 where none is."""
    if not truth.any():
        return 2.0
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)  # whole groups of equal scores only
    good = np.flatnonzero((right >= precision) & last)
    return max(0.5, float(score[order][good[-1]])) if len(good) else 2.0


def thresholds(scored: DataFrame, precision: float) -> dict[int, float]:
    """`threshold_for` per ``kind`` from all rows of ``kind int, score double, right boolean, n long``.

    Scores are put in order per kind and slice of the score's range; one number per slice
    carries the rows of higher slices.  A kind that is missing has no threshold.
    """
    right = F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right")
    scores = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), right)
    scores = scores.withColumn("slice", F.floor(F.col("score") * SLICES))
    higher = Window.partitionBy("kind").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = scores.groupBy("kind", "slice").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    before = slices.select(
        "kind", "slice", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("right").over(higher), F.lit(0)).alias("right_before"),
    )
    inside = Window.partitionBy("kind", "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    taken = scores.join(F.broadcast(before), ["kind", "slice"]).select(  # at most 4,097 slices a kind
        "kind", "score", (F.col("n_before") + F.sum("n").over(inside)).alias("n"),
        (F.col("right_before") + F.sum("right").over(inside)).alias("right"),
    )
    good = taken.where((F.col("right") > 0) & (F.col("right") / F.col("n") >= precision))
    return {r.kind: max(0.5, r.score) for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}
