"""An R-tree over count vectors, and its join with a bound on the overlap of the sets behind them.

A point has the numbers of a set's members in each hash group. Two sets share at most the sum over the groups of the
smaller count; two nodes, at most the sum of the smaller of their upper corners. A node pair is left when even
that cannot reach the overlap that the smallest sets below it would need.
"""

from __future__ import annotations

import numpy as np

#: So many that two unlinked sets of some thousand members seldom pass the bound.
GROUPS = 256
LEAF, FAN = 16, 8
#: Counts from here on are not held; sets this large are bounded by their sizes alone.
LARGE = 65_535


def count_vector(members: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((members >> np.uint64(56)).astype(np.int64), minlength=GROUPS), LARGE).astype(np.uint16)


def reaches(top_a: np.ndarray, top_b: np.ndarray, least_a: np.ndarray, least_b: np.ndarray, most_a: np.ndarray, most_b: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the pairs (i of a, j of b) can have overlap / union >= num / den, by upper corners, least and largest sizes."""
    out = (least_a[i] * num <= most_b[j] * den) & (least_b[j] * num <= most_a[i] * den)
    at = np.flatnonzero(out)
    for k in range(0, len(at), 1 << 14):
        now = at[k : k + (1 << 14)]
        x, y = i[now], j[now]
        bound = np.minimum(top_a[x], top_b[y]).sum(1, dtype=np.int64)
        large = (most_a[x] >= LARGE) | (most_b[y] >= LARGE)
        bound = np.where(large, np.minimum(most_a[x], most_b[y]), bound)
        out[now] = bound * (num + den) >= num * (least_a[x] + least_b[y])
    return out


class RTree:
    """Bulk-loaded: points in order of size and their fullest groups, packed into leaves, leaves into nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> None:
        spread = np.argsort(-points.astype(np.float32).var(0))[:6]
        self.order = np.lexsort((*(points[:, g] for g in spread[::-1]), groups, np.log2(np.maximum(sizes, 1)).astype(np.int64)))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], groups[self.order])]
        fan = LEAF
        while len(self.levels[-1][1]) > 1:
            top, least, most, group = self.levels[-1]
            first = np.arange(0, len(least), fan)
            low, high = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
            self.levels.append((np.maximum.reduceat(top, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.where(low == high, low, -1)))
            fan = FAN

    def join(self, other: RTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Points (of self, of other) of different groups whose sets can be as similar as num / den.

        A group of -1 stands for nodes of several groups; points have a group of their own >= 0.
        """
        a, b = len(self.levels) - 1, len(other.levels) - 1
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            va, la, ma, ga = self.levels[a]
            vb, lb, mb, gb = other.levels[b]
            keep = (ga[i] != gb[j]) | (ga[i] < 0)
            i, j = i[keep], j[keep]
            keep = reaches(va, vb, la, lb, ma, mb, i, j, num, den)
            i, j = i[keep], j[keep]
            if a == 0 and b == 0:
                return self.order[i], other.order[j]
            if a >= b:
                i, j = _children(i, j, a, len(self.levels[a - 1][1]))
                a -= 1
            else:
                j, i = _children(j, i, b, len(other.levels[b - 1][1]))
                b -= 1


def _children(i: np.ndarray, j: np.ndarray, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    fan = LEAF if level == 1 else FAN
    first = i * fan
    count = np.minimum(first + fan, n) - first
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), np.repeat(j, count)
