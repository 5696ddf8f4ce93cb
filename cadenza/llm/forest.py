"""Spanning forests of links within a task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over row numbers; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = up
                return up
            up = nxt

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.roots()
        new = root[i] != root[j]
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.up[max(ra, rb)] = min(ra, rb)
                self.links.append((a, b))
