"""A wavelet tree over a permutation, level by level in arrays, that answers many range reports at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class WaveletTree:
    """Points (i, values[i]); values are a permutation of range(len(values)). Each level halves the values by one bit, lower half first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.firsts = [], []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            self.firsts.append(int(low.sum()))
            values = np.concatenate([values[low], values[~low]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) of every point with left <= i < right and low <= value < high, for arrays of queries."""
        for s in range(0, len(left), at_once):
            query = np.arange(s, min(s + at_once, len(left)))
            l, r, node = left[query], right[query], np.zeros(len(query), np.int64)  # noqa: E741
            for zeros, first, bit in zip(self.zeros, self.firsts, range(self.bits - 1, -1, -1)):
                below_l, below_r = zeros[l], zeros[r]
                query = np.concatenate([query, query])
                l, r = np.concatenate([below_l, first + l - below_l]), np.concatenate([below_r, first + r - below_r])  # noqa: E741
                node = np.concatenate([2 * node, 2 * node + 1])
                keep = (l < r) & ((node + 1) << bit > low[query]) & (node << bit < high[query])
                query, l, r, node = query[keep], l[keep], r[keep], node[keep]  # noqa: E741
            if len(query):
                yield query, node
