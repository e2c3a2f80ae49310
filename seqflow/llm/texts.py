"""Text rules and row plumbing shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes that are no part of an alphanumeric word: ASCII other than digits and lower-case letters.
_NOT_ALNUM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_TO_SPACE = bytes.maketrans(_NOT_ALNUM, b" " * len(_NOT_ALNUM))

SLICE_BYTES = 4 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, other letters untouched."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.lower().translate(_TO_SPACE).split()


class Memo(dict):
    """``make(key)`` remembered; emptied when it holds ``limit`` entries, so memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 256):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class RecentMemo(dict):
    """``make(key)`` remembered in two generations of ``limit`` entries: a full one becomes the old one, whose entries
    move on when asked for again, so what is frequent is made once. Longer keys than ``longest`` are not kept."""

    def __init__(self, make: Callable, limit: int, longest: int = 256):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """``make()``, kept for later tasks of the same Python worker; only the latest key is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def offsets(counts: np.ndarray) -> np.ndarray:
    """Start of each row's part when parts of the given sizes lie one after another, and the end."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32)), values)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes, or one row, so that what a task makes of a batch stays small."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_texts(df: DataFrame, columns: list[str], fn: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn(iterator of record batches)`` to the named columns only; other columns are never read."""
    return df.select(*columns).mapInArrow(lambda batches: fn(slices(batches)), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null matching null; keeps the left columns and the right ones that are no keys.

    The right side's columns get internal names first, so nothing clashes with columns of the left.
    """
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns])
    cond = None
    for k in keys:
        one = left[f"`{k}`"].eqNullSafe(renamed[f"__r_{k}"])
        cond = one if cond is None else cond & one
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    out = out.drop(*[f"__r_{k}" for k in keys])
    return out.withColumnsRenamed({f"__r_{c}": c for c in right.columns if c not in keys})
