"""Words shared by a small and a large set of texts, counted where the large one lies.

The small set's words are numbered and broadcast; a task looks up each word of its texts there. Words
of the large set are never rows, and none of them is moved.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.functions import sequences as S

SLICE = 1 << 20       # letters looked at together
GRID = 1 << 24        # cells of a table of words and texts, at most
CODES = 1 << 62       # words are numbers below this
MIX = np.uint64(0x9E3779B97F4A7C15)


def group_key(by: Sequence[str]) -> Column:
    """The ``by`` columns as one text; null if any is null, as in an equi-join."""
    if not by:
        return F.lit("")
    known = [F.col(c).isNotNull() for c in by]
    return F.when(F.forall(F.array(*known), lambda x: x), F.to_json(F.struct(*by)))


class Lookup:
    """Positions of numbers in a sorted list: one probe of a table, a search for those that lost their slot."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - max(4, int(4 * len(codes)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        at = self._slot(codes)
        self.slots[at] = np.arange(len(codes), dtype=np.int32)
        self.lost = np.flatnonzero(self.slots[at] != np.arange(len(codes))).astype(np.int32)
        self.shared = np.zeros(len(self.slots), bool)
        self.shared[at[self.lost]] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * MIX) >> self.shift

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are listed, as ascending indices, and where."""
        slot = self._slot(codes)
        at = self.slots[slot]
        hit = self.codes[at] == codes
        if len(self.lost):
            rest = np.flatnonzero(self.shared[slot] & ~hit)
            lost = self.codes[self.lost]
            near = np.minimum(np.searchsorted(lost, codes[rest]), len(lost) - 1)
            same = lost[near] == codes[rest]
            at[rest[same]] = self.lost[near[same]]
            hit[rest[same]] = True
        found = np.flatnonzero(hit)
        return found, at[found]


@dataclass
class SmallSet:
    """The words of one group of the small set, and which of its texts hold them."""

    words: Lookup
    starts: np.ndarray  # word -> its stretch of ``texts``
    texts: np.ndarray
    n: int              # texts
    grid: np.ndarray | None = None  # the same as a table, if texts have many words in common

    def count(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that hold any of ``words``, and how many of them."""
        if self.grid is not None:
            n = self.grid[words].sum(0, dtype=np.uint32)
        else:
            first, many = self.starts[words], self.starts[words + 1] - self.starts[words]
            total = int(many.sum())
            texts = self.texts[np.repeat(first - np.cumsum(many) + many, many) + np.arange(total)]
            if self.n > 8 * total + 1024:
                return np.unique(texts, return_counts=True)
            n = np.bincount(texts, minlength=self.n)
        hit = np.flatnonzero(n)
        return hit, n[hit]


@dataclass
class SmallSide:
    k: int
    letters: np.ndarray  # byte -> digit; 0 for bytes that no word holds
    base: int
    groups: dict[str, SmallSet]
    ids: dict[str, pa.Array]
    n_words: dict[str, np.ndarray]
    repeated: bool = False  # an id has several rows

    def codes(self, data: np.ndarray) -> np.ndarray:
        """The number of the word that begins at each byte; words with a foreign byte equal no listed one."""
        kind = np.int32 if self.base ** self.k < 1 << 31 else np.int64
        digits = self.letters[data].astype(kind)
        out = digits[:max(0, len(data) - self.k + 1)].copy()
        for j in range(1, self.k):
            out *= kind(self.base)
            out += digits[j:j + len(out)]
        return out


def small_side(rows: DataFrame, by: Sequence[str], id_col: str, seq_col: str, k: int) -> SmallSide | None:
    """The words of ``rows``, whose size the caller has bounded; null if a word isn't plain ASCII or has too many codes.

    Half of a character beyond 16 bits reads as a question mark in a word, so such words are left to the join.
    """
    words = rows.select(group_key(by).alias("key"), F.col(id_col).alias("id"), S.kmers(seq_col, k).alias("w"))
    table = words.where("key IS NOT NULL AND size(w) > 0").toArrow().sort_by("key").combine_chunks()
    flat = table["w"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.string()))
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    joined = "".join(flat.flatten().to_pylist())
    if not joined.isascii() or "?" in joined:
        return None
    data = np.frombuffer(joined.encode("ascii"), np.uint8)
    known = np.unique(data)
    letters = np.zeros(256, np.uint8)
    letters[known] = np.arange(1, len(known) + 1)
    side = SmallSide(k, letters, len(known) + 1, {}, {}, {})
    if side.base ** k >= CODES:
        return None
    codes = side.codes(data)[::k] if len(data) else np.zeros(0, np.int32)
    offsets = flat.offsets.to_numpy().astype(np.int64) - flat.offsets[0].as_py()
    n_words = np.diff(offsets)
    keys, ids = table["key"].to_pylist(), table["id"].to_pylist()
    lo = 0
    while lo < len(keys):
        hi = bisect_right(keys, keys[lo])
        mine = slice(int(offsets[lo]), int(offsets[hi]))
        listed, word = np.unique(codes[mine], return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(listed)))])
        holders = np.repeat(np.arange(hi - lo), n_words[lo:hi])[np.argsort(word, kind="stable")]
        key = keys[lo]
        grid = None
        if len(listed) * (hi - lo) <= min(GRID, 16 * len(holders)):
            grid = np.zeros((len(listed), hi - lo), np.uint8)
            grid[np.repeat(np.arange(len(listed)), np.diff(starts)), holders] = 1
        side.groups[key] = SmallSet(Lookup(listed), starts, holders, hi - lo, grid)
        side.ids[key] = pa.array(ids[lo:hi], table.schema.field("id").type)
        side.n_words[key] = n_words[lo:hi]
        side.repeated |= len(set(ids[lo:hi])) < hi - lo
        lo = hi
    return side


def _rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Slices of a bounded number of letters: the rows, their bytes, and where each text begins and ends."""
    for b in batches:
        text = b.column("seq")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            data = text.buffers()[2]
            size = int(offsets[to] - offsets[at])
            data = np.frombuffer(data, np.uint8, size, int(offsets[at])) if size else np.zeros(0, np.uint8)
            here = offsets[at:to + 1] - offsets[at]
            yield b.slice(at, to - at), data, here[:-1], here[1:], b.column("key").slice(at, to - at).to_pylist()
            at = to


def _distinct(words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each word once; ``seen`` has a place for every word and needs no clearing."""
    order = np.arange(len(words))
    seen[words] = order
    return words[seen[words] == order]


def _found(side: SmallSide, codes: np.ndarray, lo: int, hi: int, small: SmallSet, seen: np.ndarray) -> np.ndarray:
    """The distinct listed words of the text in ``lo..hi``."""
    if hi - lo < side.k:
        return np.zeros(0, np.int32)
    return _distinct(small.words.find(codes[lo:hi - side.k + 1])[1], seen)


def _count_words(side: SmallSide, text: bytes) -> int:
    """The number of distinct words of an ASCII text without line breaks."""
    if len(text) < side.k:
        return 0
    if 8 * side.k > 63:
        return len({text[i:i + side.k] for i in range(len(text) - side.k + 1)})
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    out = data[:len(data) - side.k + 1].copy()
    for j in range(1, side.k):
        out = (out << 8) | data[j:j + len(out)]
    out.sort()
    return 1 + int(np.count_nonzero(out[1:] != out[:-1]))


def shared_words(large: DataFrame, by: Sequence[str], id_col: str, seq_col: str, side: SmallSide, small_name: str,
                 large_name: str, small_type: str, count_large: bool) -> DataFrame:
    """``by..., small_name, large_name, shared, n_words`` for every row of ``large`` and text of ``side`` that share a word.

    ``shared`` counts the distinct common words. ``n_words`` counts the distinct words of the small
    text, or with ``count_large`` of the large one.
    """
    spark = large.sparkSession
    shared = spark.sparkContext.broadcast(side)
    given = F.lit(None).cast("int")
    if count_large:  # what the pattern takes for a word is left to it where that isn't every stretch of letters
        odd = (F.octet_length(seq_col) != F.length(seq_col)) | F.col(seq_col).rlike("[\r\n]")
        given = F.when(odd, F.size(S.kmers(seq_col, side.k)))
    rows = large.select(*by, F.col(id_col).alias(large_name), group_key(by).alias("key"),
                        F.coalesce(F.col(seq_col), F.lit("")).alias("seq"), given.alias("given"))
    rows = rows.where("key IS NOT NULL")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    keep = [*by, large_name]
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{small_name}` {small_type}, shared bigint, n_words int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        seen = {key: np.zeros(len(g.words.codes), np.int64) for key, g in side.groups.items()}
        for rows, data, lows, highs, keys in _rows(batches, side.k):
            codes = side.codes(data)
            given = rows.column("given").to_pylist() if count_large else None
            at, ids, counts, sizes = [], [], [], []
            for i, key in enumerate(keys):
                small = side.groups.get(key)
                if small is None:
                    continue
                words = _found(side, codes, lows[i], highs[i], small, seen[key])
                if not len(words):
                    continue
                hit, n = small.count(words)
                at.append(np.full(len(hit), i))
                ids.append(side.ids[key].take(pa.array(hit)))
                counts.append(n)
                if count_large:
                    known = given[i]
                    size = _count_words(side, data[lows[i]:highs[i]].tobytes()) if known is None else known
                    sizes.append(np.full(len(hit), size))
                else:
                    sizes.append(side.n_words[key][hit])
            if at:
                took = rows.select(keep).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays(
                    [*took.columns, pa.concat_arrays(ids), pa.array(np.concatenate(counts), pa.int64()),
                     pa.array(np.concatenate(sizes), pa.int32())], [*keep, small_name, "shared", "n_words"])

    return rows.mapInArrow(run, schema)
