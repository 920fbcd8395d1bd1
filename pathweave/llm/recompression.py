"""Run-length grammars by recompression, and exact longest common extensions on them.

Several texts of numbers stand behind one another, with a closing number of its own before, between
and behind them that no block or pair ever takes in, so no extension crosses a border. Levels
alternate:

- block compression replaces every maximal block of one number by one new number,
- pair compression deals the numbers to two sides and replaces every neighbouring (left, right)
  by one new number; of several ways of dealing one that leaves few numbers is taken.

Equal stretches of a level become equal stretches of the next but for their ends. So an extension
climbs while both places begin a number of the next level, and on its way down compares whole
numbers. Both directions use the same grammar, and all questions take each level together: an
answer costs a few steps a level, and levels are logarithmic in the longest text.
"""

from __future__ import annotations

import numpy as np

from pathweave.llm.texts import mixed


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int32)


class Level:
    """Numbers of a level and, once there is a next one, the places of both in the other."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None, below: int = 0):
        self.symbols = symbols
        self.up = None
        if first is not None:
            self.first = first.astype(np.int32)
            self.last = np.append(first[1:], below).astype(np.int32) - 1
        starts = np.concatenate(([0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1))
        self.starts, self.counts = starts, np.diff(np.append(starts, len(symbols)))
        #: Equal numbers from a place on, itself included, by direction; none if all are different.
        self.runs = None
        if self.counts.max() > 1:
            place = np.arange(len(symbols))
            begin = np.repeat(starts, self.counts)
            left = place - begin + 1
            self.runs = {
                1: (np.repeat(self.counts, self.counts) - left + 1).astype(np.int32),
                -1: left.astype(np.int32),
            }


class Grammar:
    """``symbols`` begin and end with, and hold between texts, negative numbers, each once."""

    def __init__(self, symbols: np.ndarray):
        closers = int((symbols < 0).sum())
        self.levels = [Level(symbols.astype(np.int32))]
        while len(self.levels[-1].symbols) >= 2 * closers:
            level = self.levels[-1]
            whole = level.symbols.astype(np.int64)
            if level.runs is not None:
                most = int(level.counts.max())
                self._grow(level.starts, _numbered(whole[level.starts] * (most + 1) + level.counts))
            else:
                second = self._seconds(whole)
                starts = np.flatnonzero(~second)
                paired = np.append(second[1:], False)[starts]
                right = np.where(paired, whole[np.minimum(starts + 1, len(whole) - 1)] + 1, 0)
                self._grow(starts, _numbered(whole[starts] * (int(whole.max()) + 2) + right))

    def _grow(self, starts: np.ndarray, fresh: np.ndarray) -> None:
        level = self.levels[-1]
        closing = level.symbols[starts] < 0
        fresh[closing] = level.symbols[starts][closing]
        begins = np.zeros(len(level.symbols), np.int32)
        begins[starts[1:]] = 1
        level.up = np.cumsum(begins, dtype=np.int32)
        self.levels.append(Level(fresh, starts, len(level.symbols)))

    def _seconds(self, whole: np.ndarray) -> np.ndarray:
        """Which numbers are the second of a pair; neighbours are different."""
        inner = (whole[:-1] >= 0) & (whole[1:] >= 0)
        bits = mixed(whole.view(np.uint64) + np.uint64(len(self.levels) << 40))
        best, most = None, -1
        for shift in (3, 19, 35, 51):
            right = (bits >> np.uint64(shift)) & np.uint64(1) == 1
            for sides in (right, ~right):
                pairs = inner & ~sides[:-1] & sides[1:]
                if (count := int(pairs.sum())) > most:
                    best, most = pairs, count
            if 4 * most >= inner.sum():
                break
        if not most:  # few numbers are left: deal the first two that are neighbours apart
            at = int(np.argmax(inner))
            best = inner & (whole[:-1] == whole[at]) & (whole[1:] == whole[at + 1])
        return np.concatenate(([False], best))

    def extensions(self, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
        """Equal numbers from the different places ``a`` and ``b`` on, rightwards (1) or leftwards (-1)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        begin = a.copy()
        top = np.zeros(len(a), np.int64)
        climbing = np.arange(len(a))
        for k, level in enumerate(self.levels[:-1]):
            edges = self.levels[k + 1].first if step > 0 else self.levels[k + 1].last
            at, to, free = self._aligned(level, edges, a[climbing], b[climbing], step)
            a[climbing], b[climbing] = at, to
            climbing, at, to = climbing[free], at[free], to[free]
            if not len(climbing):
                break
            a[climbing], b[climbing] = level.up[at], level.up[to]
            top[climbing] = k + 1
        for k in range(int(top.max(initial=0)), -1, -1):
            level = self.levels[k]
            here = np.flatnonzero(top >= k)
            at, to = self._passed(level, a[here], b[here], step)
            if k:
                edges = level.first if step > 0 else level.last
                at, to = edges[at], edges[to]
            a[here], b[here] = at, to
        return (a - begin) * step

    @staticmethod
    def _aligned(level: Level, edges: np.ndarray, a, b, step: int):
        """Places moved over equal numbers until both are edges, and which of them are."""
        todo = np.arange(len(a))
        free = np.zeros(len(a), bool)
        while len(todo):
            at, to = a[todo], b[todo]
            both = (edges[level.up[at]] == at) & (edges[level.up[to]] == to)
            free[todo[both]] = True
            todo = todo[~both & (level.symbols[at] == level.symbols[to])]
            Grammar._move(level, a, b, todo, step)
        return a, b, free

    @staticmethod
    def _passed(level: Level, a, b, step: int):
        """Places moved over equal numbers."""
        todo = np.arange(len(a))
        while len(todo):
            todo = todo[level.symbols[a[todo]] == level.symbols[b[todo]]]
            Grammar._move(level, a, b, todo, step)
        return a, b

    @staticmethod
    def _move(level: Level, a, b, todo, step: int) -> None:
        far = step
        if level.runs is not None:
            far = np.minimum(level.runs[step][a[todo]], level.runs[step][b[todo]]) * step
        a[todo] += far
        b[todo] += far
