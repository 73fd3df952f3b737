"""Regression trees with exact splits, grown level by level on rows that a task holds.

Every feature's rows are sorted once; a level keeps them sorted within its nodes by a stable partition, so that a level costs a few passes
over the rows that are still in play. Thresholds lie halfway between neighbouring values; of equal splits the first feature's lowest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Gains this near, as a share, are equal but for the order in which rows were added up.
TIE = 1e-10


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; ``left`` is -1 in a leaf, and the right child follows the left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The value of each column of ``x`` (features, rows)."""
        node, inside = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while len(inside):
            at = node[inside]
            inside, at = inside[(more := self.left[at] >= 0)], at[more]
            node[inside] = self.left[at] + ~(x[self.feature[at], inside] <= self.threshold[at])
        return self.value[node]


def sorted_rows(x: np.ndarray) -> list[np.ndarray]:
    return [np.argsort(v, kind="stable").astype(np.int32) for v in x]


def grown(x: np.ndarray, order: list[np.ndarray], y: np.ndarray, times: np.ndarray, depth: int, least: int) -> Tree:
    """The tree of rows with ``times`` above 0, each counted so often; a leaf has ``least`` such rows or more. ``order``: see ``sorted_rows``."""
    centre = y.mean()
    y = y - centre
    ty = times * y
    order = [o[times[o] > 0] for o in order] if not times.all() else order
    feature, threshold, left, value = [], [], [], []
    sizes, known, side = np.array([len(order[0])]), 1, np.zeros(len(y), bool)
    for level in range(depth + 1):
        k, starts, node = len(sizes), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        o = order[0]
        w, s = times[o], ty[o]
        all_w, all_s = np.add.reduceat(w, starts), np.add.reduceat(s, starts)
        value.append(all_s / all_w + centre)
        best, by, cut = np.zeros(k), np.full(k, -1), np.zeros(k)
        open_ = (np.minimum.reduceat(y[o], starts) < np.maximum.reduceat(y[o], starts)) & (sizes >= 2 * least) & (level < depth)
        if open_.any():
            # how many rows a split after this one leaves on either side
            here = np.arange(len(o)) - starts[node] + 1
            may = open_[node] & (here >= least) & (sizes[node] - here >= least)
            for f, o in enumerate(order):
                v = x[f][o]
                at = np.flatnonzero(may[:-1] & (v[:-1] < v[1:]))
                if not len(at):
                    continue
                cw, cs, m = np.cumsum(times[o]), np.cumsum(ty[o]), node[at]
                before_w, before_s = np.append(0.0, cw)[starts], np.append(0.0, cs)[starts]
                lw, ls = cw[at] - before_w[m], cs[at] - before_s[m]
                gap = ls * all_w[m] - all_s[m] * lw
                gain = gap * gap / (lw * (all_w[m] - lw)) / all_w[m]
                first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                top = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain >= (1 - TIE) * np.repeat(top, np.diff(np.append(first, len(m)))))
                hit = hit[np.append(True, m[hit][1:] != m[hit][:-1])]
                hit = hit[gain[hit] > (1 + TIE) * best[m[hit]]]
                i, j = at[hit], m[hit]
                middle = v[i] + (v[i + 1] - v[i]) / 2
                best[j], by[j], cut[j] = gain[hit], f, np.where(middle < v[i + 1], middle, v[i])
        split = by >= 0
        left.append(np.where(split, known + 2 * (np.cumsum(split) - 1), -1))
        feature.append(by)
        threshold.append(cut)
        known += 2 * int(split.sum())
        if not split.any():
            break
        kept, o = split[node], order[0]
        side[o[kept]] = x[by[node[kept]], o[kept]] <= cut[node[kept]]
        sizes, node = sizes[split], (np.cumsum(split) - 1)[node[kept]]
        starts = np.cumsum(sizes) - sizes
        lefts = np.add.reduceat(side[o[kept]].astype(np.int64), starts)
        to_left = np.arange(len(node)) - starts[node] < lefts[node]
        low, high = np.flatnonzero(to_left), np.flatnonzero(~to_left)
        for f, o in enumerate(order):
            o = o if len(low) + len(high) == len(o) else o[kept]
            g, out = side[o], np.empty_like(o)
            out[low], out[high] = o[g], o[~g]
            order = [*order[:f], out, *order[f + 1 :]]
        sizes = np.stack([lefts, sizes - lefts], axis=1).ravel()
    return Tree(*(np.concatenate(c) for c in (feature, threshold, left, value)))


def forest_sum(x: np.ndarray, y: np.ndarray, ask: np.ndarray, numbers: range, seed: int, depth: int, least: int) -> np.ndarray:
    """The sum of the predictions for ``ask`` of the trees with these numbers, each grown on as many rows as there are, drawn with replacement."""
    order, total = sorted_rows(x), np.zeros(ask.shape[1])
    for k in numbers:
        drawn = np.random.default_rng([seed, k]).integers(0, len(y), len(y))
        total += grown(x, order, y, np.bincount(drawn, minlength=len(y)).astype(float), depth, least).predict(ask)
    return total


def boosted(x: np.ndarray, y: np.ndarray, ask: np.ndarray, rounds: int, step: float, depth: int, least: int) -> np.ndarray:
    """The mean, and ``step`` times a tree of what is left, round after round."""
    order, ones = sorted_rows(x), np.ones(len(y))
    now, out = np.full(len(y), y.mean()), np.full(ask.shape[1], y.mean())
    for _ in range(rounds):
        tree = grown(x, order, y - now, ones, depth, least)
        now, out = now + step * tree.predict(x), out + step * tree.predict(ask)
    return out
