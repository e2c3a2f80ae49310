"""Run-length grammars by recompression, with longest common extensions.

A sequence is rewritten in rounds. Block compression replaces every stretch of one
symbol by a symbol of its own; pair compression deals the symbols to a left and a
right side and replaces every left-right pair. Both look at nothing but the symbols
themselves, so equal stretches are rewritten alike up to their ends. The levels are
the grammar's derivation, top down; equal symbols of a level spell equal stretches.

A common extension climbs the levels as long as both places are ends of symbols,
passing equal symbols, and descends again where they differ. A level costs at most
one step either way, and a query climbs no higher than its answer is long. Many
queries climb together, as arrays.

Several sequences share one grammar: a separator between them has a symbol of its
own and is never rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Level:
    """One level and its place under the next one.

    Places are the gaps between symbols. ``floor[x]`` is the next level's symbol that place ``x`` starts
    or lies in, ``down`` the place of each of the next level's gaps.
    """

    sym: np.ndarray
    blocks: bool = False
    floor: np.ndarray | None = None
    down: np.ndarray | None = None

    def cut(self, starts: np.ndarray) -> None:
        m = len(self.sym)
        flag = np.zeros(m + 1, np.int32)
        flag[starts] = 1
        flag[m] = 1
        self.floor = np.cumsum(flag, dtype=np.int32) - np.int32(1)
        self.down = np.append(starts, m).astype(np.int32)

    def is_end(self, x: np.ndarray) -> np.ndarray:
        return self.down[self.floor[x]] == x

    def left(self, x: np.ndarray, way: int) -> np.ndarray:
        """Symbols up to the end of the block ahead of place ``x``."""
        if way > 0:
            return self.down[self.floor[x] + 1] - x
        return x - self.down[self.floor[x - 1]]


class Grammar:
    """The grammar of sequences of symbols 0, 1, ..., each with at least one separator on either side.

    ``symbols`` holds the sequences with a separator ahead of the first, between any two and behind the
    last; separators are negative and differ from one another.
    """

    def __init__(self, symbols: np.ndarray):
        fresh = int(symbols.max(initial=0)) + 1
        self.levels = [_Level(symbols.astype(np.int64))]
        salt = 0
        while True:
            level = self.levels[-1]
            s = level.sym
            joined = (s[1:] >= 0) & (s[:-1] >= 0)
            if not joined.any():
                break
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            if len(starts) < len(s):
                after, fresh = self._blocks(s, starts, fresh)
                level.blocks = True
            else:
                salt += 1
                starts, after, fresh = self._pairs(s, joined, fresh, salt)
                if len(after) == len(s):
                    continue
            level.cut(starts)
            self.levels.append(_Level(after))

    @staticmethod
    def _blocks(s: np.ndarray, starts: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        size = np.diff(np.append(starts, len(s)))
        after = s[starts].copy()
        long = np.flatnonzero(size > 1)
        names, at = np.unique(after[long] * (int(size.max()) + 1) + size[long], return_inverse=True)
        after[long] = fresh + at
        return after, fresh + len(names)

    @staticmethod
    def _pairs(s: np.ndarray, joined: np.ndarray, fresh: int, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
        mixed = (s.astype(np.uint64) + np.uint64(salt)) * _MIX
        right = ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(63)).astype(bool)
        one, other = (joined & (a[:-1] & b[1:]) for a, b in ((~right, right), (right, ~right)))
        heads = np.flatnonzero(one if one.sum() >= other.sum() else other)
        keep = np.ones(len(s), bool)
        keep[heads + 1] = False
        starts = np.flatnonzero(keep)
        names, at = np.unique(s[heads] * fresh + s[heads + 1], return_inverse=True)
        after = s.copy()
        after[heads] = fresh + at
        return starts, after[starts], fresh + len(names)

    def extend(self, a: np.ndarray, b: np.ndarray, way: int = 1) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` on: to the right (1) or to the left (-1).

        Places are different gaps of the same sequence, as numbers of symbols ahead of them.
        """
        off = 0 if way > 0 else -1
        x, y = a.astype(np.int64), b.astype(np.int64)
        stopped = np.zeros(len(x), np.int32)   # the level where symbols differ
        climbing = np.arange(len(x))
        for k, level in enumerate(self.levels):
            i, j = x[climbing], y[climbing]
            if level.down is None:   # the top
                stopped[climbing] = k
                while len(climbing):
                    same = level.sym[i + off] == level.sym[j + off]
                    climbing, i, j = climbing[same], i[same] + way, j[same] + way
                    x[climbing], y[climbing] = i, j
                break
            inside = ~(level.is_end(i) & level.is_end(j))
            at = np.flatnonzero(inside)
            if len(at):
                u, v = i[at], j[at]
                step = self._step(level, u, v, off, way)
                i[at], j[at] = u + step, v + step
                x[climbing], y[climbing] = i, j
            up = level.is_end(i) & level.is_end(j)
            stopped[climbing[~up]] = k
            climbing = climbing[up]
            if not len(climbing):
                break
            x[climbing], y[climbing] = level.floor[i[up]], level.floor[j[up]]
        for k in range(int(stopped.max(initial=0)) - 1, -1, -1):
            level = self.levels[k]
            at = np.flatnonzero(stopped > k)
            u, v = level.down[x[at]].astype(np.int64), level.down[y[at]].astype(np.int64)
            step = self._step(level, u, v, off, way)
            x[at], y[at] = u + step, v + step
        return way * (x - a)

    @staticmethod
    def _step(level: _Level, u: np.ndarray, v: np.ndarray, off: int, way: int) -> np.ndarray:
        """Pass one symbol of a pair, or what two blocks share, where symbols agree."""
        same = level.sym[u + off] == level.sym[v + off]
        if not level.blocks:
            return same * way
        step = np.zeros(len(u), np.int64)
        at = np.flatnonzero(same)
        step[at] = np.minimum(level.left(u[at], way), level.left(v[at], way)) * way
        return step
