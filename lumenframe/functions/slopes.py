"""The median of all pairwise slopes of weighted points, in memory linear in the points."""

from __future__ import annotations

import numpy as np


def _inversions(seq: np.ndarray, w: np.ndarray) -> int:
    """The sum of w[a] * w[b] over a < b with seq[a] > seq[b], of a permutation of 0 to n - 1: sorted bit by bit from the top, ones count that stand before zeros of the same prefix."""
    total, n, here = 0, len(seq), np.arange(len(seq))
    for s in range(int(n - 1).bit_length() - 1, -1, -1):
        one, start = (seq >> s) & 1, (seq >> (s + 1)) << (s + 1)
        ones, weight = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        np.cumsum(one, out=ones[1:])
        np.cumsum(one * w, out=weight[1:])
        total += int(((weight[:-1] - weight[start]) * w * (1 - one)).sum())
        before = ones[:-1] - ones[start]
        to = np.where(one == 1, start + (1 << s) + before, here - before)
        moved, moved_w = np.empty_like(seq), np.empty_like(w)
        moved[to], moved_w[to] = seq, w
        seq, w = moved, moved_w
    return total


class _Points:
    """Points by falling x, then rising y, so that a stable sort by y - t * x has a slope up to t, and only such, against the order of x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        order = np.lexsort((y, -x))
        self.x, self.y, self.w, self.n = x[order], y[order], times[order].astype(np.int64), len(x)
        self.rising = np.lexsort((self.y, self.x))
        self.place = np.empty(self.n, np.int64)
        self.place[self.rising] = np.arange(self.n)

    def order(self, t: float) -> np.ndarray:
        if np.isinf(t):
            return np.arange(self.n) if t > 0 else self.rising
        return np.argsort(self.y - t * self.x, kind="stable")

    def upto(self, t: float) -> int:
        """How many slopes are at most t."""
        s = self.order(t)
        return _inversions(self.place[s], self.w[s])

    def slopes(self, low: float, high: float, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """(slope, times) of the pairs that change their order between two slopes; ``chunk`` candidates are looked at at once."""
        at, rank = self.order(low), np.empty(self.n, np.int64)
        rank[self.order(high)] = np.arange(self.n)
        r = rank[at]
        first = np.minimum(np.searchsorted(np.maximum.accumulate(r), r, side="right"), np.arange(self.n))
        many = np.arange(self.n) - first
        ends, a, parts = np.cumsum(many), 0, []
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - many[a] + chunk, side="right")))
            k = many[a:b]
            right = np.repeat(np.arange(a, b), k)
            left = np.arange(len(right)) + np.repeat(first[a:b] - (np.cumsum(k) - k), k)
            swap = r[left] > r[right]
            p, q = at[left[swap]], at[right[swap]]
            p, q = p[self.x[p] < self.x[q]], q[self.x[p] < self.x[q]]
            v, back = np.unique((self.y[q] - self.y[p]) / (self.x[q] - self.x[p]), return_inverse=True)
            parts.append((v, np.bincount(back, weights=self.w[p] * self.w[q], minlength=len(v)).astype(np.int64)))
            a = b
        v, k = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.argsort(v, kind="stable")
        return v[o], k[o]


def median_slope(x: np.ndarray, y: np.ndarray, times: np.ndarray, few: int = 8, sample: int = 4096, chunk: int = 1 << 20) -> float:
    """The median of (y_j - y_i) / (x_j - x_i) over pairs of points with different x, each taken times_i * times_j times; NaN if there are none.

    Slopes up to t are counted in n log n, as inversions. Bounds, first guessed from sampled pairs, close in on the middle
    until about ``few`` * n slopes are left; those are built and ranked exactly.
    """
    p = _Points(np.asarray(x, float), np.asarray(y, float), np.asarray(times))
    same = np.add.reduceat(p.w, np.flatnonzero(np.r_[True, p.x[1:] != p.x[:-1]])) if p.n else np.zeros(1, np.int64)
    total = (int(p.w.sum()) ** 2 - int((same * same).sum())) // 2
    if not total:
        return float("nan")
    i, j = np.random.default_rng(0).integers(0, p.n, (2, sample))
    i, j = i[p.x[i] != p.x[j]], j[p.x[i] != p.x[j]]
    guess = np.sort((p.y[j] - p.y[i]) / (p.x[j] - p.x[i]))

    def ranked(k1: int, k2: int, low: float, c_low: int, high: float, c_high: int, first: list[float]) -> float:
        while c_high - c_low > few * p.n + 1000:
            inside = guess[(guess > low) & (guess < high)]
            if first:
                t = first.pop()
            elif len(inside):
                t = float(inside[len(inside) // 2])
            else:
                t = float(np.tan((np.arctan(low) + np.arctan(high)) / 2)) if np.isinf(high - low) else low + (high - low) / 2
                if not low < t < high:
                    break  # equal slopes
            if not low < t < high:
                continue
            c = p.upto(t)
            if c <= k1:
                low, c_low = t, c
            elif c > k2:
                high, c_high = t, c
            else:
                return (ranked(k1, k1, low, c_low, t, c, []) + ranked(k2, k2, t, c, high, c_high, [])) / 2
        v, k = p.slopes(low, high, chunk)
        found = v[np.minimum(np.searchsorted(np.cumsum(k), [k1 - c_low, k2 - c_low], side="right"), len(v) - 1)]
        return float((found[0] + found[1]) / 2)

    return ranked((total - 1) // 2, total // 2, -np.inf, 0, np.inf, total, [float(v) for v in np.quantile(guess, [0.47, 0.53])] if len(guess) else [])
