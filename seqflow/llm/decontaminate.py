"""Benchmark passages in documents, by a generalised suffix automaton.

The words of all test items go into one suffix automaton. The words of a
document are streamed through it; its state says how long a stretch ending at
the current word occurs in some item. A stretch of ``window`` words is a hit,
and so is a whole item that is shorter.

The automaton is broadcast. Its size follows the test items, so they are dealt
into parts of at most ``part_bytes`` text, each with an automaton of its own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.llm.texts import alnum_words, free_name, map_texts, same, utf8
from seqflow.session import materialize

WINDOW = 13
PART_BYTES = 1 << 20
FILTER_BITS = 22
HITS = "row bigint, doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


class Automaton:
    """Generalised suffix automaton over word numbers; number 0 stands for words of no item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("q", [-1]), array("q", [0])
        self.names = sorted({name for name, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        paths = []
        for name, words in items:
            if words:
                seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
                self._add(seq)
                paths.append((number[name], seq))
        self.shortest = min([window, *(len(s) for _, s in paths)])
        self._mark(paths)
        self._filter([s for _, s in paths])

    def _add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            cur = self._state(self.length[last] + 1)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _mark(self, paths: list[tuple[int, list[int]]]) -> None:
        """For states that can end a window: whose windows they are, and the window's length."""
        self.ends: dict[int, dict[int, set[int]]] = {}
        for item, seq in paths:
            n = min(self.window, len(seq))
            state = 0
            for at, c in enumerate(seq):
                state = self.next[state][c]
                if at + 1 >= n:
                    s = state  # up to the state whose stretches include the last n words
                    while self.length[self.link[s]] >= n:
                        s = self.link[s]
                    self.ends.setdefault(s, {}).setdefault(n, set()).add(item)
        # Nearest state on the way up, itself included, that ends a window.
        self.up = array("q", [-1] * len(self.next))
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.up[s] = s if s in self.ends else self.up[self.link[s]] if s else -1

    def _filter(self, seqs: list[list[int]]) -> None:
        """Hashed runs of ``gram`` item words: what fails here is in no window."""
        self.gram = min(3, self.shortest)
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for seq in seqs:
            self.bits[self._grams(np.asarray(seq, dtype=np.uint64))] = True

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - self.gram + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.gram):
            h = (h + ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of the words in which every run of ``gram`` passes the filter."""
        if len(ids) < self.shortest or not self.ids:
            return []
        fits = np.concatenate([[False], self.bits[self._grams(ids)], [False]])
        step = np.flatnonzero(fits[1:] != fits[:-1])
        first, last = step[0::2], step[1::2] + self.gram - 1
        long = last - first >= self.shortest
        return list(zip(first[long].tolist(), last[long].tolist()))

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (merged, end exclusive) and item numbers in one document."""
        spans: list[list[int]] = []
        found: set[int] = set()
        for first, last in self.stretches(ids):
            state, n = 0, 0
            for at, c in enumerate(ids[first:last].tolist(), first):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                if c in self.next[state]:
                    state, n = self.next[state][c], n + 1
                s = self.up[state]
                reach = 0
                while s != -1:
                    for size, items in self.ends[s].items():
                        if size <= n:
                            found |= items
                            reach = max(reach, size)
                    s = self.up[self.link[s]] if s else -1
                if reach:
                    start = at + 1 - reach
                    if spans and start <= spans[-1][1]:
                        # An earlier, shorter hit can lie wholly inside this one.
                        while len(spans) > 1 and start <= spans[-2][1]:
                            spans.pop()
                        spans[-1] = [min(start, spans[-1][0]), at + 1]
                    else:
                        spans.append([start, at + 1])
        return [(a, b) for a, b in spans], found


def _scan(shared, keep_row: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        get = auto.ids.get
        for b in batches:
            counts, spans, items = [], [], []
            for text in utf8(b.column(2)):
                words = alnum_words(text)
                counts.append(len(words))
                hit, found = auto.scan(np.fromiter([get(w, 0) for w in words], np.uint64, len(words)))
                spans.append([{"first": a, "last": e} for a, e in hit])
                items.append([auto.names[i] for i in found])
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array(items, pa.list_(pa.string()))], ["row", "doc_id", "n_words", "spans", "items"])
    return run


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items``: hit spans in words (merged, end exclusive) and the items found.

    One row per input row. A null or empty text has no words; an item without
    words is never found; items are named by their id as text (null ids as
    ``""``) and equal ids count once. Without items nothing is hit.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("name"),
                         F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text")).distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total * 2 // part_bytes)) if total > part_bytes else 1
    if parts > 1:
        source = materialize(source.withColumn("row", F.monotonically_increasing_id()), "passages")
    else:
        source = source.withColumn("row", F.lit(None).cast("bigint"))
    out = None
    for p in range(parts):
        mine = named if parts == 1 else named.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == p)
        rows = sorted((r["name"], alnum_words(r["text"].encode())) for r in mine.collect())  # at most part_bytes or so
        shared = spark.sparkContext.broadcast(Automaton(rows, window))
        one = map_texts(source, ["row", "doc_id", "text"], _scan(shared, parts > 1), HITS)
        out = one if out is None else out.unionByName(one)
    if parts > 1:
        merged = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = merged.withColumn("spans", _merge("spans"))
    return out.select("doc_id", "n_words", "spans", "items")


def _merge(spans: str):
    """Sorted spans joined where they touch or overlap."""
    empty = F.slice(F.col(spans), 1, 0)
    def step(done, s):
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (s["first"] <= F.get(done, F.size(done) - 1)["last"]), joined).otherwise(
            F.concat(done, F.array(s)))
    return F.aggregate(F.col(spans), empty, step)


def contamination(docs: DataFrame, items: DataFrame, coverage: int = 20, **names) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the spans and items themselves.

    A document is contaminated if it has hit words and they are at least one in ``coverage``.
    """
    found = find_passages(docs, items, **names)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans", "items")


def remove_spans(docs: DataFrame, items: DataFrame, longest: int = WINDOW, share: float = 0.05,
                 id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the words of hit spans, other columns as they were.

    Spans of ``longest`` words or more go; where hit words make up more than ``share`` of a
    document, all its spans go. A text that loses a span comes back as its remaining pieces, joined
    by one space; other texts stay byte for byte (null stays null).
    """
    row, count, hits = (free_name(docs, n) for n in ("__row", "__n_words", "__spans"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "passages")
    found = find_passages(rows, items, id_col=row, text_col=text_col, **names).where(F.size("spans") > 0).select(
        F.col("doc_id").alias(row), F.col("n_words").alias(count), F.col("spans").alias(hits))
    joined = same(rows, found, [row], "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, counts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, int(n), s, longest, share)
                          for t, n, s in zip(texts, counts, spans)])

    cleaned = clean(F.col(f"`{text_col}`"), F.col(count), F.col(hits))
    return joined.withColumn(text_col, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(text: str, n_words: int, spans, longest: int, share: float) -> str:
    hits = [(int(s["first"]), int(s["last"])) for s in spans]
    hit = sum(b - a for a, b in hits)
    drop = [(a, b) for a, b in hits if b - a >= longest or hit > share * n_words]
    if not drop:
        return text
    raw = text.encode()
    low, at, places = raw.lower(), 0, []
    for w in alnum_words(raw):
        at = low.index(w, at)  # only separators lie between two words
        places.append((at, at + len(w)))
        at += len(w)
    keep, start = [], 0
    for a, b in drop:
        keep.append(raw[start:places[a][0]])
        start = places[b - 1][1]
    keep.append(raw[start:])
    return " ".join(p for p in (k.decode().strip() for k in keep) if p)
