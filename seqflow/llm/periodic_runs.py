"""Stretches of text that repeat one period of words over and over.

A run of period q with four periods or more covers, wherever it lies, two places q
apart of the grid 0, 3q, 6q, ... These pairs are the candidates, about
``n / 3 * log n`` of them for n words; all but few fail on the first word. The
others are extended exactly to both sides by a grammar of the text
(``recompression``), and a run found by several candidates or by multiples of its
period is kept once, with its smallest period.

Periods are taken in classes of doubling size. A candidate inside a run whose period
divides its own would give that run again and is left out, so a text that repeats
one word stays cheap.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.llm.recompression import Grammar
from seqflow.llm.texts import list_array, map_texts, utf8

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
PERIODS = 4       # a run has at least this many periods
SHORTEST = 6      # and at least this many words
CANDIDATES = 1 << 20

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of all ids, the words from some place on repeat a period; a null id is left alone."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts given as word numbers, text after text: ``(text, start, length, period)``, sorted so."""
    n_texts, n_words = len(sizes), len(words)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    # Places in the grammar's sequence: one separator ahead of every text, one at the end.
    first = begins + np.arange(n_texts) + 1
    symbols = np.full(n_words + n_texts + 1, -1, np.int64)
    symbols[np.arange(n_words) + np.repeat(np.arange(n_texts), sizes) + 1] = words
    gaps = symbols < 0
    symbols[gaps] = -1 - np.arange(int(gaps.sum()))
    if not len(sizes) or sizes.max() < SHORTEST:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grammar = Grammar(symbols)
    covered_to = np.zeros(len(symbols), np.int64)   # end and period of some run over each place
    covered_by = np.ones(len(symbols), np.int64)
    found = []
    low = 1
    while low * PERIODS <= int(sizes.max()):
        fresh = []
        for text, q, i in _grid(sizes, low):
            i = first[text] + i
            alike = symbols[i] == symbols[i + q]
            alike &= ~((i + q < covered_to[i]) & (q % covered_by[i] == 0))
            text, q, i = text[alike], q[alike], i[alike]
            ahead, back = grammar.extend(i, i + q), grammar.extend(i, i + q, -1)
            long = (ahead + back + q >= np.maximum(SHORTEST, PERIODS * q))
            start, end = (i - back)[long], (i + q + ahead)[long]
            fresh.append(_distinct(np.stack([start, end, q[long], text[long]])))
        if fresh:
            new = _distinct(np.concatenate(fresh, axis=1))
            found.append(new)
            for s, e, q, _ in new.T.tolist():
                covered_to[s:e], covered_by[s:e] = e, q
        low *= 2
    runs = _distinct(np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64)
    start, end, q, text = runs
    return text, start - first[text], end - start, q


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Columns ``start, end, period, text`` by start, once for each stretch, with the smallest period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    keep = np.ones(runs.shape[1], bool)
    keep[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    runs = runs[:, keep]
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _grid(sizes: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates ``(text, q, place)`` for periods from ``low`` to twice that, in bounded parts."""
    most = np.minimum(sizes // PERIODS, 2 * low - 1)
    texts = np.flatnonzero(most >= low)
    per_text = most[texts] - low + 1
    text = np.repeat(texts, per_text)
    q = low + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    count = (sizes[text] - 1 - q) // (3 * q) + 1
    part = np.cumsum(count) // CANDIDATES
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=s) for s in ("left", "right"))):
        c = count[lo:hi]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        qs = np.repeat(q[lo:hi], c)
        yield np.repeat(text[lo:hi], c), qs, nth * 3 * qs


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row.

    ``runs`` holds each maximal stretch of at least four periods and six words, by start and period;
    ``collapsed`` is the text without what a run repeats behind its first period, words joined by one space.
    ``rewrite`` changes the words of a row first. Null and empty texts have no words and collapse to "";
    repeated ids and rows are rows of their own. Other columns are not read; an empty table gives no rows.
    Texts are worked on in slices of about 4 MB; a longer text is a slice by itself and takes some
    hundred bytes a word in its task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [t.split() for t in utf8(b.column(1))]
            if rewrite:
                texts = [rewrite(i, w) for i, w in zip(ids, texts)]
            numbers: dict[bytes, int] = {}
            sizes = np.array([len(w) for w in texts], np.int64)
            words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
            of, start, length, period = find_runs(words, sizes)
            counts = np.bincount(of, minlength=len(texts))
            rows = list(zip(start.tolist(), length.tolist(), period.tolist()))
            at, collapsed = 0, []
            for t, c in zip(texts, counts.tolist()):
                collapsed.append(_collapse(t, rows[at:at + c]))
                at += c
            structs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes), list_array(counts, structs),
                pa.array(collapsed, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(source, ["doc_id", "text"], run, RUNS)
