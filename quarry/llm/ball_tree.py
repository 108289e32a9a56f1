"""A ball tree over sparse non-negative integer vectors, searched for the largest inner products.

Every node knows its centroid, the radius of the ball around it that holds all
its rows, and for each coordinate how far above the centroid a row lies there.
A query is a set of coordinates.  Its inner product with any row of a node is at
most its product with the centroid plus, at once, its own length times the
radius, and the coordinate radii of the query's coordinates; the lesser of both
is the node's bound.  On documents the second is much the tighter one.  Bounds
are doubles, widened by more than their rounding; scores are integers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 16
#: Relative width that is added to squared radii and to bounds; rounding is below it by some orders of magnitude.
SLACK, BOUND_SLACK = 1e-11, 1e-9


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


@dataclass
class Rows:
    """Sparse rows, none of them empty: row i has the coordinates ``cols[start[i]:start[i + 1]]``."""

    start: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        length = np.diff(self.start)[rows]
        at = spans(self.start[rows], length)
        return Rows(np.concatenate(([0], np.cumsum(length))), self.cols[at], self.vals[at])

    def products(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.cols] * self.vals, self.start[:-1])


@dataclass
class Node:
    begin: int  # rows of the tree's order
    end: int
    left: int = -1  # node numbers, -1 in a leaf
    right: int = -1


class BallTree:
    """``weight`` (of each coordinate) times a row's values is the space of the tree; a query is a set of coordinates."""

    def __init__(self, rows: Rows, weight: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n = len(rows.start) - 1
        self.columns, local = np.unique(rows.cols, return_inverse=True)
        own = Rows(rows.start, local, weight[rows.cols].astype(np.int64) * rows.vals)
        order, self.nodes, stack = np.arange(n), [Node(0, n)], [0]
        while stack:
            node = self.nodes[stack.pop()]
            if node.end - node.begin <= leaf_rows:
                continue
            inside = order[node.begin : node.end]
            along = self._direction(own.take(inside))
            order[node.begin : node.end] = inside[np.argsort(along, kind="stable")]
            middle = (node.begin + node.end) // 2
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [Node(node.begin, middle), Node(middle, node.end)]
            stack += [node.left, node.right]
        self.order, self.rows = order, own.take(order)
        self._balls()

    def _direction(self, rows: Rows) -> np.ndarray:
        """Where each row lies between two that are far apart: the farthest from the first one, and the farthest from that."""
        vals, squares = rows.vals.astype(np.float64), np.add.reduceat(rows.vals.astype(np.float64) ** 2, rows.start[:-1])
        dense = np.zeros(len(self.columns))

        def to(row: int) -> np.ndarray:
            at = slice(rows.start[row], rows.start[row + 1])
            dense[rows.cols[at]] = vals[at]
            found = np.add.reduceat(dense[rows.cols] * vals, rows.start[:-1])
            dense[rows.cols[at]] = 0
            return found

        first = int((squares - 2 * to(0)).argmax())
        to_first = to(first)
        return to_first - to(int((squares - 2 * to_first).argmax()))

    def _balls(self) -> None:
        """Centroids, radii and coordinate radii, from the leaves up; a parent's ball holds those of its children."""
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [()] * len(self.nodes)  # coordinates, sums and maxima
        self.radius = np.zeros(len(self.nodes))
        for number in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            node = self.nodes[number]
            size = node.end - node.begin
            if node.left < 0:
                at = slice(self.rows.start[node.begin], self.rows.start[node.end])
                cols, total = self.rows.cols[at], self.rows.vals[at].astype(np.float64)
                most = total
            else:
                cols, total, most = (np.concatenate(x) for x in zip(sums[node.left], sums[node.right], strict=True))
            order = np.argsort(cols, kind="stable")
            held, first = np.unique(cols[order], return_index=True)
            sums[number] = held, np.add.reduceat(total[order], first), np.maximum.reduceat(most[order], first)
            centre = sums[number][1] / size
            if node.left < 0:
                slot = np.searchsorted(held, cols)
                row = np.repeat(np.arange(size), np.diff(self.rows.start[node.begin : node.end + 1]))
                square = (centre**2).sum()
                away = np.bincount(row, total * (total - 2 * centre[slot]), size) + square
                self.radius[number] = np.sqrt((np.maximum(away, 0) + SLACK * (np.bincount(row, total**2, size) + square)).max())
            else:
                for child in (node.left, node.right):
                    apart = centre.copy()
                    apart[np.searchsorted(held, sums[child][0])] -= sums[child][1] / (self.nodes[child].end - self.nodes[child].begin)
                    self.radius[number] = max(self.radius[number], self.radius[child] + np.sqrt((apart**2).sum()) * (1 + SLACK))
        term, node_of = np.concatenate([x[0] for x in sums]), np.repeat(np.arange(len(sums)), [len(x[0]) for x in sums])
        by_term = np.argsort(term, kind="stable")
        sizes = np.array([n.end - n.begin for n in self.nodes])
        self.mean_start = np.searchsorted(term[by_term], np.arange(len(self.columns) + 1))
        self.mean_node, self.mean = node_of[by_term], (np.concatenate([x[1] for x in sums]) / sizes[node_of])[by_term]
        self.above = np.concatenate([x[2] for x in sums])[by_term] - self.mean

    def bounds(self, local: np.ndarray) -> np.ndarray:
        """For each node, no less than the score of any of its rows; ``local`` are the query's coordinates in this tree."""
        at = spans(self.mean_start[local], self.mean_start[local + 1] - self.mean_start[local])
        node = self.mean_node[at]
        centre, above = np.bincount(node, self.mean[at], len(self.nodes)), np.bincount(node, self.above[at], len(self.nodes))
        return (centre + np.minimum(above, self.radius * np.sqrt(len(local)))) * (1 + BOUND_SLACK) + 1

    def search(self, query: np.ndarray, ids: np.ndarray, best: Best) -> int:
        """Puts the rows of the largest scores into ``best``; gives how many rows were scored.

        ``ids`` are those of the rows as the tree was given them.  Nodes are
        opened in the order of their bounds, until none can hold a row that is
        as good as the last of ``best``.
        """
        place = np.searchsorted(self.columns, query)
        place = place[place < len(self.columns)]
        local = place[np.isin(self.columns[place], query)]
        if not len(local):
            return 0
        bound, asked, scored = self.bounds(local), np.zeros(len(self.columns), np.int64), 0
        asked[local] = 1
        open_nodes = [(-bound[0], 0)]
        while open_nodes and -open_nodes[0][0] >= best.least:
            node = self.nodes[heapq.heappop(open_nodes)[1]]
            if node.left >= 0:
                for child in (node.left, node.right):
                    if bound[child] >= best.least:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            at = slice(self.rows.start[node.begin], self.rows.start[node.end])
            found = np.add.reduceat(asked[self.rows.cols[at]] * self.rows.vals[at], self.rows.start[node.begin : node.end] - self.rows.start[node.begin])
            scored += len(found)
            good = np.flatnonzero(found >= max(1, best.least))
            if len(good):
                best.add(found[good], ids[self.order[node.begin : node.end][good]])
        return scored


class Best:
    """The k best (score, id): the highest scores, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))  # a row that ties may have a smaller id
