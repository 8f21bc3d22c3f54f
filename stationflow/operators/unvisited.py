"""Stations that a truck hasn't visited yet, in a k-d tree from which they are taken.

A node is a run of the stations in tree order, with the box of their coordinates and the
number that is left. The nearest one left is found by going down into the nearer child
first; boxes without stations left or beyond the best distance are passed over, so a walk over n
stations costs about n log n. A box's distance is never above that of a station in it, rounding
included, and a box is passed over on a strict comparison only: equally near
stations are all met, and the one that comes first wins.
"""

from __future__ import annotations

import math

import numpy as np

LEAF = 32


class Unvisited:
    """Places 0 to n - 1 by their coordinates; those without finite ones are nearest to nothing."""

    def __init__(self, coordinates: np.ndarray, leaf: int = LEAF):
        self.at = np.asarray(coordinates, np.float64)
        self.left = np.ones(len(self.at), bool)
        self.placed = np.isfinite(self.at).all(axis=1)
        self.first = 0  # no place before it is left
        self.lost = 0  # nor one without coordinates before it
        self.order = np.flatnonzero(self.placed)
        self.box: list[tuple[float, float, float, float]] = []
        self.run: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.count: list[int] = []
        self.parent: list[int] = []
        self.leaf_of = np.full(len(self.at), -1)
        if len(self.order):
            self._build(leaf)

    def _build(self, leaf: int) -> None:
        todo = [(0, len(self.order), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.run)
            here = self.at[self.order[a:b]]
            low, high = here.min(axis=0), here.max(axis=0)
            self.box.append((low[0], low[1], high[0], high[1]))
            self.run.append((a, b))
            self.count.append(b - a)
            self.parent.append(parent)
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if b - a <= leaf:
                self.leaf_of[self.order[a:b]] = node
                self.order[a:b].sort()
                continue
            middle = (a + b) // 2
            axis = int((high - low).argmax())
            self.order[a:b] = self.order[a:b][np.argpartition(here[:, axis], middle - a)]
            todo += [(a, middle, node), (middle, b, node)]

    def take(self, place: int) -> None:
        self.left[place] = False
        node = int(self.leaf_of[place])
        while node >= 0:
            self.count[node] -= 1
            node = self.parent[node]

    def _away(self, node: int, y: float, x: float) -> float:
        low_y, low_x, high_y, high_x = self.box[node]
        dy = low_y - y if y < low_y else y - high_y if y > high_y else 0.0
        dx = low_x - x if x < low_x else x - high_x if x > high_x else 0.0
        return math.sqrt(dy * dy + dx * dx)

    def nearest(self, place: int) -> int:
        """The nearest place left, the first of equally near ones; where nothing is near
        (no coordinates here, or none left that has some), the first place left. There has to be one."""
        if not self.placed[place] or not self.count or not self.count[0]:
            while not self.left[self.first]:
                self.first += 1
            return self.first
        y, x = self.at[place].tolist()
        best, found = math.inf, -1
        stack = [(self._away(0, y, x), 0)]
        while stack:
            away, node = stack.pop()
            if away > best:
                continue
            children = self.children[node]
            if children is None:
                a, b = self.run[node]
                own = self.order[a:b]
                own = own[self.left[own]]
                distance = np.sqrt(((self.at[own] - self.at[place]) ** 2).sum(axis=1))
                i = int(distance.argmin())
                if distance[i] < best or (distance[i] == best and own[i] < found):
                    best, found = float(distance[i]), int(own[i])
                continue
            next_ones = sorted(((self._away(c, y, x), c) for c in children if self.count[c]), reverse=True)
            stack += next_ones
        return found
