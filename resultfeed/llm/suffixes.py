"""Hash-compared suffix sort over byte windows, in numpy.

``Text`` holds prefix polynomial hashes of some bytes: hash(i, j) of any range takes two lookups.  Two
suffixes are compared by a binary search for their longest common extension over such hashes, and by the
byte behind it: a comparison costs the logarithm of the depth.  ``sort_within`` is a bottom-up mergesort by
these comparisons, of all buckets at once: at each level every suffix finds its place in the run
beside its own by binary search.  Equal windows stand side by side in the end, in the order in which
they came (merging is stable), and what the hashes call equal is verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from .arrays import PIECE_BYTES
from .common import process_cache

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(seed: int) -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return made(BASE), made(INVERSE)


class Text:
    """Prefix hashes of ``data``; ``hash`` of ranges is mixed, ``same`` compares ranges of one length."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        if n <= PIECE_BYTES:  # one pair of power tables serves all pieces
            self.up, self.down = (x[: n + 1] for x in process_cache(f"powers {PIECE_BYTES}", lambda: _powers(PIECE_BYTES + 1)))
        else:
            self.up, self.down = _powers(n + 1)
        self.data = data
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(letters(seed)[data] * self.up[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of ``k`` bytes."""
        n = len(self.data) - k + 1
        return mixed((self.prefix[k:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        return (self.prefix[a + length] - self.prefix[a]) * self.down[a] == (self.prefix[b + length] - self.prefix[b]) * self.down[b]

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Longest common extension of suffixes a and b, ``depth`` at most; both have ``depth`` bytes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), depth, np.int64)
        whole = self.same(a, b, depth)
        low[whole] = depth
        open_ = np.flatnonzero(~whole)
        high[open_] = depth - 1
        while len(open_):
            middle = (low[open_] + high[open_] + 1) >> 1
            equal = self.same(a[open_], b[open_], middle)
            low[open_[equal]] = middle[equal]
            high[open_[~equal]] = middle[~equal] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def less(self, a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """a < b and a == b, by the first ``depth`` bytes."""
        far = self.common(a, b, depth)
        equal = far == depth
        at = np.minimum(far, depth - 1)
        return (self.data[a + at] < self.data[b + at]) & ~equal, equal


def sort_within(text: Text, starts: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by their first ``depth`` bytes inside each bucket; stable.

    ``bucket`` ascends; suffixes of one bucket stand together.
    """
    n = len(starts)
    order = np.arange(n)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    first, many = np.repeat(edge, size), np.repeat(size, size)
    width = 1
    while width < (size.max() if n else 0):
        live = np.flatnonzero(many > width)  # places in buckets that still have two runs
        rel = live - first[live]
        run = rel // width
        twin = run ^ 1
        low0 = first[live] + twin * width
        high0 = np.minimum(low0 + width, first[live] + many[live])
        has = low0 < first[live] + many[live]
        live, rel, run, low0, high0 = live[has], rel[has], run[has], low0[has], high0[has]
        low, high = low0.copy(), high0.copy()
        mine, left = starts[order[live]], run % 2 == 0
        open_ = np.arange(len(live))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            other = starts[order[middle]]
            smaller, equal = text.less(other, mine[open_], depth)
            before = smaller | (equal & ~left[open_])  # equal ones of the left run stay in front
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
            open_ = open_[low[open_] < high[open_]]
        pair = first[live] + (run // 2) * 2 * width
        target = pair + (rel - run * width) + (low - low0)
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2
    return order


#: Bytes compared at once when equal windows are verified.
_AT_ONCE = 1 << 22


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(data, depth)
    out, step = np.ones(len(a), bool), max(1, _AT_ONCE // depth)
    for i in range(0, len(a), step):
        out[i : i + step] = (windows[a[i : i + step]] == windows[b[i : i + step]]).all(axis=1)
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``data`` at a and b, of equal length, hold the same bytes."""
    out, total = np.ones(len(a), bool), np.cumsum(length)
    at = 0
    while at < len(a):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + _AT_ONCE, "right")))
        n = length[at:end]
        edge = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(edge, n)
        out[at:end] = np.logical_and.reduceat(data[np.repeat(a[at:end], n) + place] == data[np.repeat(b[at:end], n) + place], edge)
        at = end
    return out


def repeated(text: Text, starts: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Whether each window of ``depth`` bytes equals an earlier one of its bucket (earlier in ``starts``).

    A bucket in which the bytes contradict the hashes is done again by bytes alone.
    """
    order = sort_within(text, starts, bucket, depth)
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    a, b = order[:-1], order[1:]
    at = np.flatnonzero((bucket[a] == bucket[b]) & text.same(starts[a], starts[b], depth))
    good = equal_bytes(text.data, starts[a[at]], starts[b[at]], depth)
    out[b[at[good]]] = True
    for wrong in np.unique(bucket[b[at[~good]]]):
        seen: set[bytes] = set()
        for i in np.flatnonzero(bucket == wrong):
            window = text.data[starts[i] : starts[i] + depth].tobytes()
            out[i] = window in seen
            seen.add(window)
    return out
