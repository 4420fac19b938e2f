"""Pairs of sorted texts at one edit, by banded edit-matrix rows along shared prefixes.

The texts of a group stand in code-point order, so those that share a prefix are one
range.  A row of the edit matrix belongs to a range, not to a text: what adjacent texts
share (their longest common prefix) is computed once.  With one edit allowed a row needs
the three cells around its diagonal, and a range is left as soon as they all exceed one.
All texts of a chunk are looked up at once, depth by depth.
"""

from __future__ import annotations

import numpy as np


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded by zeros, one column of zeros before and two behind, and the lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros((len(texts), int(lengths.max(initial=0)) + 3), np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1] = flat
    return codes, lengths


def shared_prefix(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the (different) texts at `a` and `b`."""
    return (codes[a, 1:] != codes[b, 1:]).argmax(axis=1)


def near_pairs(codes: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all texts of one group that differ by exactly one edit.

    `first` marks where a group begins; the texts of a group are distinct and in order.
    """
    n = len(lengths)
    lcp = np.full(n, -1, np.int64)
    inside = np.flatnonzero(~first)
    lcp[inside] = shared_prefix(codes, inside - 1, inside)

    def level(depth: int):
        """Ranges of texts that share `depth` code points: their starts, ends, and the range of each text."""
        starts = np.flatnonzero(lcp < depth)
        return starts, np.append(starts[1:], n), np.cumsum(lcp < depth) - 1

    found_i, found_j = [], []
    starts, ends, range_of = level(0)
    same = np.arange(n)  # texts whose own prefix still has others behind them: row (1, 0, 1)
    text, at = np.empty(0, np.int64), np.empty(0, np.int64)  # a text and the range that it is compared with
    row = np.empty((3, 0), bool)  # cells of the row that are 1; the others are more
    depth = 0
    while len(same) or len(text):
        char = depth + 1  # column of the next code point
        deeper, deeper_ends, deeper_of = level(depth + 1)
        # a row with a 1 only goes on where a code point agrees on the diagonal of that 1
        key = range_of[deeper] << 21 | codes[deeper, char]
        texts, ranges, rows = [], [], []
        wanted = [codes[text, char + k] for k in (-1, 0, 1)]
        for k in range(3):
            use = row[k] & (wanted[k] != 0)
            for e in range(k):
                use &= ~(row[e] & (wanted[e] == wanted[k]))  # followed already
            who = np.flatnonzero(use)
            look = at[who] << 21 | wanted[k][who]
            spot = np.searchsorted(key, look)
            spot[spot == len(key)] = 0
            hit = (key[spot] == look) & (deeper_ends[spot] > text[who] + 1)
            who, spot = who[hit], spot[hit]
            texts.append(text[who])
            ranges.append(spot)
            rows.append(np.stack([row[e][who] & (wanted[e][who] == wanted[k][who]) for e in range(3)]))
        # from the own prefix every range behind the text's own begins with one edit
        same = same[ends[range_of[same]] > same + 1]
        own = deeper_of[same]
        last = deeper_of[ends[range_of[same]] - 1]
        count = last - own
        who = np.repeat(same, count)
        spot = np.repeat(own + 1, count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        texts.append(who)
        ranges.append(spot)
        new = codes[deeper[spot], char]
        rows.append(np.stack([np.ones(len(who), bool), lengths[who] > depth, codes[who, char + 1] == new]))
        same = same[deeper_ends[deeper_of[same]] > same + 1]

        depth += 1
        starts, ends, range_of = deeper, deeper_ends, deeper_of
        text, at, row = np.concatenate(texts), np.concatenate(ranges), np.concatenate(rows, axis=1)
        target = starts[at]
        cell = lengths[text] - depth + 1
        ended = (lengths[target] == depth) & (target > text) & (cell >= 0) & (cell <= 2)
        ended[ended] = row[cell[ended], np.flatnonzero(ended)]
        found_i.append(text[ended])
        found_j.append(target[ended])
    return np.concatenate([np.empty(0, np.int64), *found_i]), np.concatenate([np.empty(0, np.int64), *found_j])
