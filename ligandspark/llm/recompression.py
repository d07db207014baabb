"""Run-length grammars by recompression, and longest common extensions in them.

A sequence of symbols is compressed level by level: block compression names each
maximal run of one symbol, pair compression names pairs of a left and a right
symbol, where every symbol is on one side.  Both look at a symbol's neighbours
only, so equal parts get equal names but for a few symbols at their ends.  The
levels of names are the derivation of a run-length grammar.  An extension query
climbs from two places while the names agree, and comes down where they differ:
it reads a few symbols per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOP = 32            # symbols at which compression ends
TRIALS = 3          # partitions into left and right that a pair level is chosen from


@dataclass
class Level:
    """Symbols of a level; ``first[k]`` is the place of the first child of
    symbol ``k`` on the level below, and ``parent`` the symbol above (both of
    ``first`` and ``sides`` have an entry past the end)."""
    names: np.ndarray
    first: np.ndarray | None        # None on the lowest level
    blocks: bool                    # the level above was made from this one by block compression
    parent: np.ndarray | None = None    # None on the highest level


def _blocks(s: np.ndarray) -> np.ndarray | None:
    """Starts of the maximal runs of equal symbols; None if all have length 1."""
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return None if len(starts) == len(s) else starts


def _pairs(s: np.ndarray, level: int) -> np.ndarray:
    """Starts of the symbols of the next level, when each left symbol joins a
    right symbol that follows it."""
    best = None
    for trial in range(TRIALS):
        salt = np.uint64((level * TRIALS + trial + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ salt
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        side = h >> np.uint64(63) == 1
        for left in (side, ~side):
            joined = left[:-1] & ~left[1:]
            n = int(joined.sum())
            if best is None or n > best[0]:
                best = n, joined
    keep = np.ones(len(s), bool)
    keep[1:] = ~best[1]
    return np.flatnonzero(keep)


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers from 0 for equal pairs of numbers."""
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


class Grammar:
    """The levels over a sequence whose first and last symbols occur once only
    (so no extension runs over the ends)."""

    def __init__(self, s: np.ndarray) -> None:
        self.levels = [Level(np.asarray(s, np.int64), None, False)]
        pairs = 0
        while len(self.levels[-1].names) > TOP:
            top = self.levels[-1]
            starts, blocks = _blocks(top.names), True
            if starts is None:
                starts, blocks, pairs = _pairs(top.names, pairs), False, pairs + 1
                if len(starts) == len(top.names):
                    if pairs > 64 + 4 * TOP:
                        break
                    continue
            n = len(top.names)
            sizes = np.diff(np.append(starts, n))
            if blocks:
                names = _named(top.names[starts], sizes)
            else:
                second = np.where(sizes == 2, top.names[np.minimum(starts + 1, n - 1)] + 1, 0)
                names = _named(top.names[starts], second)
            top.blocks, top.parent = blocks, np.repeat(np.arange(len(starts)), sizes)
            self.levels.append(Level(names, np.append(starts, n), False))

    def _step(self, k: int, a: np.ndarray, b: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Past the equal symbols at ``a`` and ``b`` of level ``k``: one symbol, or
        where the level's blocks are known, what both blocks have left."""
        level = self.levels[k]
        if not level.blocks:
            return a + way, b + way
        first = self.levels[k + 1].first
        if way > 0:
            left = np.minimum(first[level.parent[a] + 1] - a, first[level.parent[b] + 1] - b)
        else:
            left = np.minimum(a - first[level.parent[a]], b - first[level.parent[b]]) + 1
        return a + way * left, b + way * left

    def extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Number of equal symbols from the places ``i`` and ``j`` on to the right
        (``way`` 1), or from them to the left (-1), both included.  ``i`` and
        ``j`` differ, and the ends are symbols that occur once."""
        a, b = np.array(i, np.int64), np.array(j, np.int64)
        at = np.zeros(len(a), np.int64)             # the level at which a query turned
        up = np.arange(len(a))
        for k in range(len(self.levels) - 1):
            level, above = self.levels[k], self.levels[k + 1].first
            edge = (lambda x: above[level.parent[x]] == x) if way > 0 else (
                lambda x: above[level.parent[x] + 1] - 1 == x)  # noqa: B023
            for _ in range(2):                      # by local consistency one step brings both to an edge
                inside = ~(edge(a[up]) & edge(b[up]))
                who = up[inside]
                who = who[level.names[a[who]] == level.names[b[who]]]
                if not len(who):
                    break
                a[who], b[who] = self._step(k, a[who], b[who], way)
            ready = edge(a[up]) & edge(b[up])
            # equal blocks of unequal rests, or unequal symbols: down from here
            up = up[ready]
            a[up], b[up], at[up] = level.parent[a[up]], level.parent[b[up]], k + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            who = np.flatnonzero(at == k)
            todo = who
            while len(todo):
                todo = todo[level.names[a[todo]] == level.names[b[todo]]]
                a[todo], b[todo] = self._step(k, a[todo], b[todo], way)
            if k:
                first = level.first
                if way > 0:
                    a[who], b[who] = first[a[who]], first[b[who]]
                else:
                    a[who], b[who] = first[a[who] + 1] - 1, first[b[who] + 1] - 1
                at[who] = k - 1
        return way * (a - np.asarray(i))
