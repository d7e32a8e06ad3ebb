"""K-d trees over points: leaves for points, the leaves within a budget of a point, and tiles of bounded size for joins leaf by leaf."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes of a k-d tree. Node i splits ``axis[i]`` at ``cut[i]`` (values up to the cut go to the first child); a leaf has axis -1."""

    axis: np.ndarray
    cut: np.ndarray
    kids: np.ndarray

    def leaves(self) -> int:
        return int((self.axis < 0).sum())


@dataclass(frozen=True)
class Budget:
    """What a range search may spend: over axes on which the box lies above the point, below it, and over both.

    The cost of an axis is the gap between point and box, squared for ``power`` 2. ``step`` is 1 for whole numbers,
    where the upper side of a cut begins one above it.
    """

    up: float
    down: float
    total: float
    power: int = 1
    step: int = 0


def grow(points: np.ndarray, most: int) -> Tree:
    """A tree over ``points`` with at most ``most`` of them in a leaf, unless all points of the leaf are equal.

    A node splits the axis of the largest variance about the middle of its points.
    """
    axis, cut, kids = [], [], []

    def build(rows: np.ndarray) -> int:
        me = len(axis)
        axis.append(-1)
        cut.append(0.0)
        kids.append((-1, -1))
        if len(rows) <= max(1, most):
            return me
        part = points[rows]
        k = int(part.var(axis=0).argmax())
        column = part[:, k]
        low, high = column.min(), column.max()
        if low == high:
            return me
        at = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
        if at == high:  # the upper side must hold something
            at = column[column < high].max()
        left = column <= at
        axis[me], cut[me] = k, float(at)
        kids[me] = (build(rows[left]), build(rows[~left]))
        return me

    build(np.arange(len(points)))
    return Tree(np.array(axis), np.array(cut), np.array(kids).reshape(-1, 2))


def place(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf (a node number) of every point."""
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while len(rows):
        rows = rows[tree.axis[node[rows]] >= 0]
        here = node[rows]
        node[rows] = tree.kids[here, (points[rows, tree.axis[here]] > tree.cut[here]).astype(np.int64)]
    return node


def reach(tree: Tree, points: np.ndarray, budget: Budget) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with the rows of ``points`` whose budget reaches its box; boxes out of reach are pruned with all below them."""
    low, high = {}, {}

    def gap(rows: np.ndarray, k: int, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        x = points[rows, k]
        return np.maximum(lo - x, 0) ** budget.power, np.maximum(x - hi, 0) ** budget.power

    def walk(node: int, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(rows):
            return
        k = int(tree.axis[node])
        if k < 0:
            yield node, rows
            return
        lo, hi = low.get(k, -np.inf), high.get(k, np.inf)
        before = gap(rows, k, lo, hi)
        for side in (0, 1):
            new = (lo, float(tree.cut[node])) if side == 0 else (float(tree.cut[node]) + budget.step, hi)
            after = gap(rows, k, *new)
            u, d = up + after[0] - before[0], down + after[1] - before[1]
            ok = (u <= budget.up) & (d <= budget.down) & (u + d <= budget.total)
            low[k], high[k] = new
            yield from walk(int(tree.kids[node, side]), rows[ok], u[ok], d[ok])
            low[k], high[k] = lo, hi

    zero = np.zeros(len(points))
    yield from walk(0, np.arange(len(points)), zero, zero.copy())


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


DATA, QUERY = 0, 1


def deal(rows: np.ndarray, salts: np.ndarray, kind: int, data_blocks: int, query_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one leaf over its tiles: ``rows`` repeated, and the data and query block of each.

    A leaf with too many points or queries is cut in blocks by salt, and every data block meets every query block in
    a tile of its own: a data row goes to its block's tiles for all query blocks, a query row to those for all data blocks.
    """
    own, other = (data_blocks, query_blocks) if kind == DATA else (query_blocks, data_blocks)
    block = np.repeat(salts[rows] % own, other)
    rest = np.tile(np.arange(other), len(rows))
    return np.repeat(rows, other), *((block, rest) if kind == DATA else (rest, block))


class Forest:
    """Connected components of links that arrive bit by bit: ``root`` holds the smallest linked number so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
