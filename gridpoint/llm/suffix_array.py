"""Suffix arrays by induced sorting, in array operations, and permuted common prefixes.

Suffixes are classed as larger (L) or smaller (S) than their follower. Leftmost smaller ones cut the string into
substrings, which are sorted and named; the string of names is sorted by the same procedure where names repeat. From the
sorted leftmost smaller suffixes the L suffixes are induced, from those the S suffixes. Over a small alphabet induction
goes bucket by bucket, over a large one in rounds: a suffix's place is its symbol's, then its follower's, until none tie.
"""

from __future__ import annotations

import numpy as np

SMALL = 1024


def smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their follower; the last, a unique least symbol, counts as smaller."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    rising = text[differs] < text[differs + 1]
    out = np.ones(n, bool)
    out[: n - 1] = np.repeat(rising, np.diff(np.concatenate([[-1], differs])))
    return out


def names(text: np.ndarray, is_s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each leftmost smaller position up to the next one, and how many differ."""
    n, m = len(text), len(at)
    length = np.diff(np.append(at, n)) + 1
    length[-1] = 1
    code = text.astype(np.uint64) * np.uint64(2) + is_s + np.uint64(1)
    code = np.append(code, np.uint64(0))
    bits = int(code.max()).bit_length()
    each = 63 // bits

    def word(rows: np.ndarray, begin: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(begin, begin + each):
            place = np.minimum(at[rows] + k, n)
            out = (out << np.uint64(bits)) | np.where(k < length[rows], code[place], np.uint64(0))
        return out

    rank = np.unique(word(np.arange(m), 0), return_inverse=True)[1]
    begin = each
    while (rows := np.flatnonzero(length > begin)).size:
        more = np.zeros(m, np.int64)
        more[rows] = np.unique(word(rows, begin), return_inverse=True)[1] + 1
        rank = np.unique(rank * (m + 2) + more, return_inverse=True)[1]
        begin += each
    return rank, int(rank.max()) + 1


def by_symbol(found: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends positions to their symbols' buckets, in order."""
    if not len(found):
        return
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    edges = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1], [True]]))
    for s, e in zip(edges[:-1], edges[1:]):
        into[symbols[s]].append(found[s:e])


def induced_by_buckets(text: np.ndarray, is_s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    size, empty = int(text.max()) + 1, np.zeros(0, np.int64)
    join = lambda parts: np.concatenate(parts) if parts else empty
    lms: list[list[np.ndarray]] = [[] for _ in range(size)]
    by_symbol(sorted_lms, text[sorted_lms], lms)
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        wave, parts = join(large[c]), []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            symbols = text[before]
            wave = before[symbols == c]
            by_symbol(before[symbols != c], symbols[symbols != c], large)
        large[c] = [join(parts)]
        before = join(lms[c])
        before = before[before > 0] - 1
        by_symbol(before, text[before], large)
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    small[0] = [np.array([len(text) - 1])]
    out = []
    for c in range(size - 1, -1, -1):
        wave, parts = join(small[c]), []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            symbols = text[before]
            wave = before[symbols == c]
            by_symbol(before[symbols != c], symbols[symbols != c], small)
        own = large[c][0][::-1]
        before = own[own > 0] - 1
        before = before[is_s[before]]
        by_symbol(before, text[before], small)
        out += [*parts, own]
    return np.concatenate(out)[::-1]


def settled(rank: np.ndarray, rows: np.ndarray) -> None:
    """Parts tied rows by their followers' ranks, round by round, until none tie. Ranks are first places in a group."""
    total = len(rank) + 1
    while len(rows):
        key = rank[rows] * total + rank[rows + 1]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        old = rank[rows]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        index = np.arange(len(rows))
        first = np.maximum.accumulate(np.where(fresh, index, 0))
        rank[rows] = old + first - np.maximum.accumulate(np.where(group, index, 0))
        rows = rows[~(fresh & np.append(fresh[1:], True))]


def induced_by_rounds(text: np.ndarray, is_s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    n, size = len(text), int(text.max()) + 1
    rank = np.zeros(n, np.int64)
    large, s = np.flatnonzero(~is_s), np.flatnonzero(is_s)
    counts = np.bincount(text[large], minlength=size), np.bincount(text[s], minlength=size)
    both = np.stack(counts, axis=1).ravel()
    starts = np.concatenate([[0], np.cumsum(both)[:-1]]).reshape(size, 2)
    symbols = text[sorted_lms]
    first = np.searchsorted(symbols, symbols)
    rank[sorted_lms] = starts[symbols, 1] + np.arange(len(sorted_lms)) - first
    rank[large] = starts[text[large], 0]
    settled(rank, large[counts[0][text[large]] > 1])
    rank[s] = starts[text[s], 1]
    settled(rank, s[(counts[1][text[s]] > 1) & (s < n - 1)])
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. text: non-negative integers that end in a unique 0, their least."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    is_s = smaller(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    rank, different = names(text, is_s, lms)
    if different == len(lms):
        order = np.empty(len(lms), np.int64)
        order[rank] = np.arange(len(lms))
    else:
        order = suffix_array(rank)
    induced = induced_by_buckets if int(text.max()) < SMALL else induced_by_rounds
    return induced(text, is_s, lms[order])


def permuted_common_prefixes(data: np.ndarray, suffixes: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For text positions: the suffix before theirs in order, and the length of what both begin with, up to most.

    data: bytes, with at least most + 8 bytes behind every position that is compared.
    """
    before = np.full(len(suffixes), -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    before = before[at]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(at), np.int64)
    rows = np.flatnonzero(before >= 0)
    done = 0
    while len(rows) and done < most:
        a, b = words[at[rows] + done], words[before[rows] + done]
        same = (a == b)
        whole = same.all(axis=1)
        out[rows] = done + np.where(whole, 8, np.argmin(same, axis=1))
        rows, done = rows[whole], done + 8
    return before, np.minimum(out, most)
