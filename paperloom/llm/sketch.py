"""Fast similarity sketching: a MinHash-like sketch by rounds of hashed bin placement.

Round i < t puts every element into a hashed bin, round t + b puts every element into
bin b; a bin keeps the smallest (round, hash).  The rounds end when every bin is full,
which the second half guarantees, so sets of any size fill all t coordinates, and two
sets agree in a coordinate with probability equal to their Jaccard similarity, with the
concentration of t independent draws.
"""

from __future__ import annotations

import numpy as np

from paperloom.llm.words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates (uint64: round above a 32-bit hash) of a non-empty set of hashes."""
    out = np.full(t, _EMPTY, np.uint64)
    n, done = len(elements), 0
    # several rounds at once for small sets: later rounds never beat earlier ones
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, 4 * t // n)), dtype=np.uint64)
        done += len(rounds)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _STEP)
        bins = (h % np.uint64(t)).astype(np.int64)
        late = rounds >= t
        if late.any():
            bins[late] = (rounds[late].astype(np.int64) - t)[:, None]
        np.minimum.at(out, bins.ravel(), ((rounds[:, None] << np.uint64(32)) | (h >> np.uint64(32))).ravel())
        if out.max() != _EMPTY:
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of equally many coordinates; the band's number is part of it."""
    parts = coordinates.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
    for column in parts.T:
        key = mix(key + column * _STEP)
    return key
