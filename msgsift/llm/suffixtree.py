"""Ukkonen's suffix tree over integer symbols, with constant-time longest common extensions."""

from __future__ import annotations

import numpy as np

_SHIFT = 32


class SuffixTree:
    """Suffix tree of ``s``, whose last symbol occurs once.

    ``lce`` answers for arrays of positions: the Euler tour visits the leaves
    in suffix order, and the shallowest node met between two leaves is their
    lowest common ancestor. Only those meeting nodes are kept (one per
    neighbouring pair of leaves), with minima over ranges of powers of two.
    """

    def __init__(self, s: np.ndarray):
        self.s = s
        self._build(s.tolist())

    def _build(self, s: list[int]) -> None:
        n = len(s)
        start, end, link, suffix = [0], [0], [0], [-1]
        edge: dict[int, int] = {}
        node = first = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    first = i
                key = node << _SHIFT | s[first]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - waiting + 1)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    a = start[child]
                    stop = end[child]
                    span = (stop if stop <= i else i + 1) - a
                    if length >= span:
                        first += span
                        length -= span
                        node = child
                        continue
                    if s[a + length] == c:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    mid = len(start)
                    edge[key] = mid
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    suffix += (-1, i - waiting + 1)
                    start[child] = a + length
                    edge[mid << _SHIFT | s[a + length]] = child
                    edge[mid << _SHIFT | c] = mid + 1
                    if last:
                        link[last] = mid
                    last = mid
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - waiting + 1
        keys = np.fromiter(edge.keys(), dtype=np.int64, count=len(edge))
        self._child = np.fromiter(edge.values(), dtype=np.int64, count=len(edge))
        self._parent, self._symbol = keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)
        self._span = np.array(end, dtype=np.int64) - np.array(start, dtype=np.int64)
        self._suffix = suffix

    def tour(self, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix starts in order, depth of the node met before each), the symbols ordered by ``rank_of``."""
        order = np.lexsort((-rank_of[self._symbol], self._parent))     # a stack hands out the last child first
        child, parent = self._child[order], self._parent[order]
        bounds = np.searchsorted(parent, np.arange(len(self._suffix) + 1)).tolist()
        kids, span, suffix = child.tolist(), self._span.tolist(), self._suffix
        out, met = [], []
        stack = kids[bounds[0]:bounds[1]]
        above = [0] * len(stack)          # depth of each waiting node's parent
        low = 0                           # shallowest node since the last leaf
        while stack:
            v, d = stack.pop(), above.pop()
            if d < low:
                low = d
            if suffix[v] >= 0:
                out.append(suffix[v])
                met.append(low)
                low = 1 << 60
            else:
                a, b = bounds[v], bounds[v + 1]
                stack += kids[a:b]
                above += [d + span[v]] * (b - a)
        return np.array(out, dtype=np.int64), np.array(met, dtype=np.int64)

    def prepare(self, order: np.ndarray, met: np.ndarray) -> None:
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self._table = [met.astype(np.int32)]
        step = 1
        while 2 * step <= len(met):
            t = self._table[-1]
            self._table.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j`` (never the same)."""
        a, b = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j])
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            t = self._table[level]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << level) + 1])
        return out
