"""Exact nearest rows among points held in one task: a balanced tree of boxes, walked for many queries at once.

Points are halved along the widest side of their box until a leaf holds a few. A query's own leaf bounds its k-th distance; then all
queries of a batch go down the tree together, level by level, and only boxes within that bound stay. Gaps to a box are computed
in the same order of columns as distances to its points, so rounding never puts a box farther than one of its points.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
#: Queries that walk the tree together, and numbers compared at once.
TOGETHER = 2_048
NUMBERS = 4_000_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis, added column by column."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for j in range(a.shape[-1]):
        gap = a[..., j] - b[..., j]
        out += gap * gap
    return out


def first_of_equal(points: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of the first ``k`` of each group of equal points: no search for ``k`` rows ever returns another."""
    order = np.lexsort(points.T)
    same = np.concatenate(([False], (points[order[1:]] == points[order[:-1]]).all(axis=1)))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - first < k])


class Boxes:
    """Tree over ``points``, all finite and at least ``k``, for searches of the ``k`` nearest."""

    def __init__(self, points: np.ndarray, k: int):
        order = first_of_equal(points, k)
        rank = np.empty(points.shape, np.int64)
        for j in range(points.shape[1]):
            rank[np.argsort(points[:, j]), j] = np.arange(len(points))
        self.depth = max(0, int(np.log2(max(1, len(order) / max(LEAF, k)))))
        bounds, self.axis, self.cut, self.low, self.high = np.array([0, len(order)]), [], [], [], []
        for level in range(self.depth + 1):
            starts = bounds[:-1]
            self.low.append(np.minimum.reduceat(points[order], starts))
            self.high.append(np.maximum.reduceat(points[order], starts))
            if level == self.depth:
                break
            axis = (self.high[-1] - self.low[-1]).argmax(axis=1)
            node = np.repeat(np.arange(len(starts)), np.diff(bounds))
            order = order[np.argsort(node * len(points) + rank[order, axis[node]])]
            middle = (bounds[:-1] + bounds[1:]) // 2
            self.axis.append(axis)
            self.cut.append(points[order[middle], axis])
            bounds = np.sort(np.concatenate((bounds, middle)))
        width = int(np.diff(bounds).max())
        at = bounds[:-1, None] + np.arange(width)
        real = at < bounds[1:, None]
        self.place = np.where(real, order[np.minimum(at, len(order) - 1)], len(points))
        self.leaves = np.where(real[..., None], points[np.minimum(self.place, len(points) - 1)], np.inf)

    def home(self, queries: np.ndarray) -> np.ndarray:
        node = np.zeros(len(queries), np.int64)
        rows = np.arange(len(queries))
        for axis, cut in zip(self.axis, self.cut):
            node = 2 * node + (queries[rows, axis[node]] >= cut[node])
        return node

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and places of the ``k`` nearest points; equal distances go to the earlier one."""
        found, place = np.empty((len(queries), k)), np.empty((len(queries), k), np.int64)
        home = self.home(queries)
        order = np.argsort(home, kind="stable")
        step = max(1, min(TOGETHER, NUMBERS // self.leaves[0].size))
        open_parts = [order[at : at + step] for at in range(0, len(order), step)][::-1]
        while open_parts:
            rows = open_parts.pop()
            reached = self._reached(queries[rows], home[rows], k)
            if reached is None:
                open_parts += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
            else:
                found[rows], place[rows] = self._best(queries[rows], *reached, k)
        return found, place

    def _reached(self, queries: np.ndarray, home: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Bounds of the k-th distances and the pairs (query, leaf) within them, by query; None if more than fit at once."""
        bound = np.partition(squared(queries[:, None], self.leaves[home]), k - 1, axis=1)[:, k - 1]
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for low, high in zip(self.low[1:], self.high[1:]):
            query, node = np.repeat(query, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            gaps = np.zeros(len(query))
            for j in range(queries.shape[1]):
                asked = queries[query, j]
                outside = np.maximum(np.maximum(low[node, j] - asked, asked - high[node, j]), 0.0)
                gaps += outside * outside
            near = gaps <= bound[query]
            query, node = query[near], node[near]
            if len(query) > NUMBERS // 4 and len(queries) > 1:
                return None
        return bound, query, node

    def _best(self, queries: np.ndarray, bound: np.ndarray, query: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        kept, step = [], max(1, NUMBERS // self.leaves[0].size)
        for at in range(0, len(query), step):
            q, n = query[at : at + step], node[at : at + step]
            d = squared(queries[q][:, None], self.leaves[n])
            row, col = np.nonzero(d <= bound[q][:, None])
            kept.append((q[row], d[row, col], self.place[n[row], col]))
        q, d, p = (np.concatenate(part) for part in zip(*kept))
        order = np.lexsort((p, d, q))
        best = order[np.searchsorted(q, np.arange(len(queries)))[:, None] + np.arange(k)]
        return d[best], p[best]
