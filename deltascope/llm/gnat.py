"""A multiway hyperplane tree over integer vectors, in which scores become distances.

With ``top`` the largest squared norm, a row ``x`` is raised by one coordinate to
``(x, sqrt(top - x.x))`` and a query ``a`` to ``(a, 0)``. Then the squared distance of
both is ``a.a + top - 2 a.x``: a window of scores is an annulus around the query, for
vectors of any length.

A node has some split points far from each other; a row belongs to the nearest one.
Between split point i and the rows below split point j the node knows the least and
greatest distance, so one distance from a query to i tells, by the triangle inequality,
whether the annulus can reach anything below j.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


def raised(vectors: np.ndarray, top: int) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", v, v), 0))])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """Split points of each node, and what is below them: a node, or leaf ``-1 - number``."""

    top: int
    splits: list[np.ndarray] = field(default_factory=list)
    below: list[np.ndarray] = field(default_factory=list)
    least: list[np.ndarray] = field(default_factory=list)
    most: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def grow(sample: np.ndarray, top: int, fanout: int, depth: int) -> Tree:
        tree = Tree(top)
        tree._add(raised(sample, top), fanout, depth)
        return tree

    def _add(self, points: np.ndarray, fanout: int, depth: int) -> int:
        """Number of a new node for these points of the sample, or a leaf."""
        chosen: list[int] = []
        if depth > 0 and len(points) >= 2 * fanout:
            far = np.full(len(points), np.inf)
            at = 0
            while len(chosen) < fanout and far[at] > 0:
                chosen.append(at)
                far = np.minimum(far, apart(points, points[at:at + 1])[:, 0])
                far[chosen] = 0
                at = int(far.argmax())
        if len(chosen) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.splits)
        splits = points[chosen]
        self.splits.append(splits)
        self.below.append(np.zeros(len(chosen), np.int64))
        self.least.append(np.full((len(chosen),) * 2, np.inf))
        self.most.append(np.full((len(chosen),) * 2, -np.inf))
        own = apart(points, splits).argmin(axis=1)
        self.below[node] = np.array([self._add(points[own == j], fanout, depth - 1) for j in range(len(chosen))])
        return node

    def walk(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that come to it, their distances from its split points, their choice)."""
        todo = [(0, np.arange(len(points)))] if self.splits else []
        while todo:
            node, rows = todo.pop()
            d = apart(points[rows], self.splits[node])
            own = d.argmin(axis=1)
            yield node, rows, d, own
            todo += [(int(b), rows[own == j]) for j, b in enumerate(self.below[node]) if b >= 0 and (own == j).any()]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(points), np.int32)
        for node, rows, _, own in self.walk(points):
            to = self.below[node][own]
            leaf[rows[to < 0]] = -1 - to[to < 0]
        return leaf

    def spans(self, points: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, i, j, least, most): distances from split point i to the points below j."""
        for node, _, d, own in self.walk(points):
            for j in np.unique(own):
                low, high = d[own == j].min(axis=0), d[own == j].max(axis=0)
                yield from ((node, i, int(j), float(low[i]), float(high[i])) for i in range(d.shape[1]))

    def note(self, node: int, i: int, j: int, least: float, most: float) -> None:
        self.least[node][i, j], self.most[node][i, j] = least, most

    def reached(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries whose annulus may hold a row of the leaf). Subtrees without rows are left out."""
        if not self.splits:
            yield 0, np.arange(len(queries))
            return
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            d = apart(queries[who], self.splits[node])
            least, most = self.least[node], self.most[node]
            for j, b in enumerate(self.below[node]):
                if not np.isfinite(most[0, j]):
                    continue
                near = np.maximum(d - most[:, j], least[:, j] - d).max(axis=1)
                far = (d + most[:, j]).min(axis=1)
                kept = who[(near <= outer[who] + slack[who]) & (far >= inner[who] - slack[who])]
                if len(kept):
                    if b < 0:
                        yield int(-1 - b), kept
                    else:
                        todo.append((int(b), kept))
