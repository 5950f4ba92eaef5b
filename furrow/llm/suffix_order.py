"""Order of suffixes by their first bytes, compared through prefix polynomial hashes.

With the hashes of all prefixes of a buffer, the hash of any stretch is one difference. The common
extension of two suffixes is found by binary search over its length, so one comparison takes logarithmic
time. Merge sort on top runs for many groups of suffixes in step; equal neighbours are verified byte by
byte, so that a hash collision can't make two different stretches one.
"""

from __future__ import annotations

import numpy as np

#: Odd, so that its powers can be divided by modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bytes to spread-out numbers, and hashes to spread-out hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """BASE to the 0, 1, ..., n - 1."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0][:n]


class PrefixHashes:
    """Hashes of all prefixes of a buffer, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self._words: np.ndarray | None = None
        self.power = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * self.power[: len(data)], out=self.sums[1:])

    def words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place as one number, in the order of the bytes."""
        if self._words is None:
            padded = np.concatenate([self.data, np.zeros(16, np.uint8)]).tobytes()
            n = (len(padded) - 8) // 8
            self._words = np.stack([np.frombuffer(padded, ">u8", n, o).astype(np.uint64) for o in range(8)])
        return self._words[at & 7, at >> 3]

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b have the same hash."""
        s, p = self.sums, self.power
        return (s[a + length] - s[a]) * p[b] == (s[b + length] - s[b]) * p[a]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension, up to the limit, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        for _ in range(limit.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.equal(a, b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether the suffix at a comes before that at b, by their first `limit` bytes."""
        n = self.common(a, b, limit)
        same = n >= limit
        n = np.where(same, 0, n)
        return ~same & (self.data[a + n] < self.data[b + n])


def sort_groups(hashes: PrefixHashes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order that sorts suffixes within each group (rows of one group are adjacent), stable.

    The first eight bytes are sorted as numbers; only suffixes that agree in them are compared by hashes.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    head = hashes.words(starts) >> np.uint64(max(0, 64 - 8 * limit))
    order = np.lexsort((head, group))
    g, h = group[order], head[order]
    fine = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
    return order[_sort_fine(hashes, starts[order], fine, limit)]


def _sort_fine(hashes: PrefixHashes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """The same by comparisons alone.

    Groups are padded to powers of two and sorted together by size. Runs of 1, 2, 4, ... merge:
    the place of an element is its own rank plus its rank in the partner run, a binary search whose
    comparisons run for all elements at once.
    """
    n = len(starts)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    order = np.arange(n)
    padded = np.ones(len(size), np.int64)
    while (padded < size).any():
        padded = np.where(padded < size, padded * 2, padded)
    for width in np.unique(padded[padded > 1]).tolist():
        rows = np.flatnonzero(padded == width)
        step = max(1, 1_000_000 // width)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            table = begin[part][:, None] + np.arange(width)[None, :]
            table[np.arange(width)[None, :] >= size[part][:, None]] = n  # padding sorts last
            table = _merge_sort(hashes, starts, table, n, limit)
            kept = table[table < n]
            place = begin[part][:, None] + np.arange(width)[None, :]
            order[place[np.arange(width)[None, :] < size[part][:, None]]] = kept
    return order


def _merge_sort(hashes: PrefixHashes, starts: np.ndarray, table: np.ndarray, n: int, limit: int) -> np.ndarray:
    """Sort each row of a table of indexes into `starts`; n stands for padding."""
    rows, width = table.shape
    run = 1
    while run < width:
        flat = table.reshape(-1)
        index = np.arange(len(flat))
        mine = index // run
        partner = (mine ^ 1) * run
        left = mine % 2 == 0
        live = np.flatnonzero(flat < n)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), run, np.int64)
        own, base, is_left = starts[flat[live]], partner[live], left[live]
        for _ in range(run.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            other = flat[base[open_] + middle]
            real = other < n
            ahead = np.zeros(len(open_), bool)  # whether the partner's element comes before mine
            r = np.flatnonzero(real)
            a, b = own[open_][r], starts[other[r]]
            # of equal ones the left run's come first
            l = is_left[open_][r]
            ahead[r[l]] = hashes.before(b[l], a[l], limit)
            ahead[r[~l]] = ~hashes.before(a[~l], b[~l], limit)
            low[open_] = np.where(ahead, middle + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], middle)
        merged = np.full(len(flat), n, np.int64)
        pair = (index[live] // (2 * run)) * (2 * run)
        merged[pair + index[live] % run + low] = flat[live]
        table = merged.reshape(rows, width)
        run *= 2
    return table


def classes(hashes: PrefixHashes, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """A number for each suffix, equal just where group and first `limit` bytes are equal."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order = sort_groups(hashes, starts, group, limit)
    a, b = starts[order[:-1]], starts[order[1:]]
    same = (group[order[:-1]] == group[order[1:]]) & hashes.equal(a, b, np.full(len(a), limit, np.int64))
    # Verification: the hash only proposes equality. Eight bytes at a time, the last eight may overlap.
    for k in sorted({*range(0, limit - 7, 8), max(0, limit - 8)}):
        hit = np.flatnonzero(same)
        x, y = hashes.words(a[hit] + k), hashes.words(b[hit] + k)
        same[hit] = (x == y) if limit >= 8 else (x >> np.uint64(64 - 8 * limit)) == (y >> np.uint64(64 - 8 * limit))
    out = np.zeros(len(starts), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)])
    return out
