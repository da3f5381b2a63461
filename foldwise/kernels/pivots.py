"""Cells around pivots, and what the triangle inequality says about their distance from a point.

Every reference row belongs to its nearest pivot. From a point's distances to the pivots follow two lower bounds on its distance to
any row of a cell: the row's distance to its pivot lies between the cell's least and largest one, and the row is nearer to its
own pivot than to the point's. Both hold in any number of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Distances computed at once: what stays in a core's cache.
BLOCK_NUMBERS = 1 << 16


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per point."""
    out = np.zeros((len(points), len(pivots)))
    for j in range(points.shape[1]):
        gap = points[:, j, None] - pivots[None, :, j]
        out += gap * gap
    return np.sqrt(out)


def assigned(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of every point, of equally near ones the first, and the distance to it."""
    home, own = np.empty(len(points), np.int64), np.empty(len(points))
    step = max(1, BLOCK_NUMBERS // max(1, len(pivots)))
    for at in range(0, len(points), step):
        d = distances(points[at : at + step], pivots)
        home[at : at + step] = d.argmin(axis=1)
        own[at : at + step] = d[np.arange(len(d)), home[at : at + step]]
    return home, own


@dataclass(frozen=True)
class Cells:
    """Pivots with the row counts and the least and largest pivot distance of their cells; empty cells are out of every reach."""

    pivots: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def around(cls, pivots: np.ndarray, home: np.ndarray, own: np.ndarray) -> Cells:
        sizes = np.bincount(home, minlength=len(pivots))
        least, most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        np.minimum.at(least, home, own)
        np.maximum.at(most, home, own)
        return cls(pivots, sizes, least, most)

    def nearest_cells(self, d: np.ndarray, k: int) -> np.ndarray:
        """Per point the nearest cells that hold ``k`` rows together, as a mask over (point, cell)."""
        filled = np.where(self.sizes > 0, d, np.inf)
        mask, home = np.zeros(d.shape, bool), filled.argmin(axis=1)
        mask[np.arange(len(d)), home] = self.sizes[home] > 0
        few = np.flatnonzero(self.sizes[home] < k)
        if len(few):
            order = np.argsort(filled[few], axis=1, kind="stable")
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            wider = np.zeros(order.shape, bool)
            np.put_along_axis(wider, order, (before < k) & (self.sizes[order] > 0), axis=1)
            mask[few] = wider
        return mask

    @cached_property
    def between(self) -> np.ndarray:
        return distances(self.pivots, self.pivots)

    def least_distance(self, d: np.ndarray) -> np.ndarray:
        """Lower bounds, loosened by what rounding may cost, on a point's distance to the rows of every cell; infinite for empty ones."""
        home = d.argmin(axis=1)
        ring = np.maximum(d - self.most[None], self.least[None] - d)
        between = self.between[home]
        near = d[np.arange(len(d)), home][:, None]
        plane = np.divide((d - near) * (d + near), 2 * between, out=np.zeros_like(d), where=between > 0)
        slack = 1e-9 * (d + np.where(self.sizes > 0, self.most, 0.0)[None]) + 1e-12
        return np.where(self.sizes > 0, np.maximum(ring, plane) - slack, np.inf)

    def within(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Mask of the cells that may hold a row within ``reach`` of a point, from the point's pivot distances ``d``.

        Bounds are loosened by what rounding may cost, so a cell is left out only if none of its rows can count.
        """
        return (self.least_distance(d) <= reach[:, None]) & (self.sizes > 0)[None]
