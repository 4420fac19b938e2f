"""Score bounds from angles to reference directions, and the exact scores where they matter.

For unit directions the angle is a metric: the angle between two vectors lies between the
difference and the sum of their angles to any third one.  Angles to a few references are
stored with each vector; the tightest of the intervals they give, multiplied by both
norms and widened by what rounding can change, holds the inner product.
"""

from __future__ import annotations

import numpy as np

#: Components beyond this size (after scaling) would make a score exceed a long.
MAX_COMPONENT = 1 << 26
#: Radians by which an angle in single precision can be wrong, and the relative error of norms and cosines.
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-9


def references(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit directions from the rows of `sample`, each the row farthest in angle from those before.

    Rows of zeros give none; without any other row the axes serve.
    """
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(sample.shape[1])[:count]
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(vectors: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of the rows to the references in single precision; a row of zeros has any, its norm is 0."""
    cosines = vectors @ refs.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def bounds(a: np.ndarray, a_norms: np.ndarray, b: np.ndarray, b_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of every row of one side with every row of the other."""
    least = np.zeros((len(a), len(b)), np.float32)
    most = np.full((len(a), len(b)), np.pi, np.float32)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        np.maximum(least, np.abs(x - y), out=least)
        total = x + y
        np.minimum(most, np.minimum(total, np.float32(2 * np.pi) - total), out=most)
    norms = a_norms[:, None] * b_norms[None, :]
    slack = 1 + norms * SCORE_SLACK
    upper = norms * np.cos(np.maximum(least.astype(np.float64) - ANGLE_SLACK, 0)) + slack
    lower = norms * np.cos(np.minimum(most.astype(np.float64) + ANGLE_SLACK, np.pi)) - slack
    return lower, upper


def scores(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products where `wanted`; other places hold anything."""
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    out = np.zeros(wanted.shape, np.int64)
    if not len(rows):
        return out
    x, y = a[rows], b[columns]
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2**53:  # doubles hold every partial sum
        out[np.ix_(rows, columns)] = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    else:
        out[np.ix_(rows, columns)] = x @ y.T
    return out


class Best:
    """The k highest scores of each group, ties by the smaller id, fed in portions."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.floor = np.full(groups, np.iinfo(np.int64).min, np.int64)  # a lower score cannot enter any more
        self.rows = [np.empty(0, np.int64)] * 3  # group, score, id
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.waiting.append((group, score, ident))
        self.held += len(group)
        if self.held > 100_000 + len(self.rows[0]):
            self.cut()

    def cut(self) -> list[np.ndarray]:
        group, score, ident = (np.concatenate(c) for c in zip(self.rows, *self.waiting))
        order = np.lexsort((ident, -score, group))
        group, score, ident = group[order], score[order], ident[order]
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
        full = rank == self.k - 1
        self.floor[group[full]] = score[full]
        keep = rank < self.k
        self.rows, self.waiting, self.held = [group[keep], score[keep], ident[keep]], [], 0
        return self.rows
