"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

A candidate is a long run of key-like characters. Its encoding (hexadecimal,
base 32, base 36, base 62, base 64) gives the alphabet for three tests, each against the
hypothesis that the string is not random in that respect:

* chi-squared uniformity of the alphabet, against a distribution as uneven as words;
* the number of runs of one character class, against the few runs of names and words in the same alphabet;
* serial correlation of neighbours, against counting and repeated sequences.

The standard scores of the first two are added up (either alone is weak for narrow alphabets);
the serial test must reject by itself, so the p-value is the larger of the two. Longer strings
say more: p-values are weighted by length, and a Benjamini-Hochberg step over
the candidates of all documents bounds the share of false findings.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.rows import stored
from seqflow.llm.texts import map_texts, utf8

KINDS = ["assign", "access", "hex", "random"]
LONGEST_WEIGHT = 4.0
STEPS = 50  # p-values are rounded up to steps of a fiftieth of a decade
DEEPEST = 30  # decades
DULL = 0.5    # larger p-values are counted only; weighted by length, even the longest stay above any limit in use
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_MIXED = re.compile(r"[+/].*[_-]|[_-].*[+/]")
_PART = re.compile(r"[A-Za-z0-9]{20,}")

#: Alphabets from the narrowest to the widest (fixed values).
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
_SETS = [(a, frozenset(a)) for a in ALPHABETS]
UNEVEN = 1.2      # chi-squared per character of word-like text
CHANGES = 0.32    # neighbours of different class in word-like text, as a part of those in random text
CORRELATION = 0.8  # of neighbours in counting or repeated sequences


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


@cache
def _turnover(alphabet: str) -> float:
    """Share of neighbours of different class in random text over the alphabet."""
    n = len(alphabet)
    return 1 - sum((k / n) ** 2 for k in Counter(map(_class, alphabet)).values())


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def randomness(text: str) -> float:
    """p-value of "not random"; 1 where no alphabet fits."""
    used = set(text)
    alphabet = next((a for a, s in _SETS if used <= s), None)
    if alphabet is None or len(used) < 3:
        return 1.0
    n, k = len(text), len(alphabet)
    at = np.array([alphabet.index(c) for c in text])
    counts = np.bincount(at, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    mean, var = (k - 1) + n * UNEVEN * k / 36, 2 * (k - 1) + 4 * n * UNEVEN * k / 36
    uniform = (mean - chi) / math.sqrt(var)
    kind = np.array([_class(c) for c in text])
    changes = int((kind[1:] != kind[:-1]).sum())
    share = CHANGES * _turnover(alphabet)
    runs = (changes - 0.5 - share * (n - 1)) / math.sqrt((n - 1) * share * (1 - share))
    a, b = at[:-1] - at[:-1].mean(), at[1:] - at[1:].mean()
    spread = math.sqrt(float((a * a).sum() * (b * b).sum()))
    r = min(0.999999, abs(float((a * b).sum()) / spread)) if spread else 0.999999
    serial = _normal((math.atanh(r) - math.atanh(CORRELATION)) * math.sqrt(n - 3))
    return max(_normal(-(uniform + runs) / math.sqrt(2)), serial, 1e-30)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = []
    low = raw.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of key-like strings that no fixed pattern touches; ``base`` is sorted by start."""
    starts, reach = [a for a, _, _ in base], [0]
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    found = []
    for m in _CANDIDATE.finditer(text):
        if reach[bisect_left(starts, m.end())] > m.start():
            continue
        if _MIXED.search(m[0]):  # no encoding has both kinds of separators
            found += [(m.start() + k.start(), m.start() + k.end(), randomness(k[0])) for k in _PART.finditer(m[0])]
        else:
            found.append((m.start(), m.end(), randomness(m[0])))
    return found


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("kind", pa.int32()), ("last", pa.int64())]))
_FOUND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("p", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, more, total, weights = [], [], [], []
        for raw in utf8(b.column(1)):
            text = raw.decode()
            spans = base_spans(text, raw)
            base.append([{"first": a, "kind": k, "last": e} for a, k, e in spans])
            seen = candidates(text, spans)
            # Dull ones are counted with the others but need not be kept: none of them can be a finding.
            total.append(len(seen))
            weights.append(sum(min(LONGEST_WEIGHT, (e - a) / 32) for a, e, _ in seen))
            more.append([{"first": a, "last": e, "p": p} for a, e, p in seen if p < DULL])
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(base, _SPAN), pa.array(more, _FOUND),
                                          pa.array(total, pa.int64()), pa.array(weights, pa.float64())],
                                         ["doc_id", "base", "found", "n_candidates", "weights"])


def _weight(c: Column) -> Column:
    return F.least(F.lit(LONGEST_WEIGHT), (c["last"] - c["first"]) / 32.0)


def discovery_limit(found: DataFrame, q: float) -> tuple[float, float]:
    """(mean weight, largest accepted step) of a weighted Benjamini-Hochberg rule over all candidates.

    Counts by rounded p-value suffice: at most ``STEPS * DEEPEST`` numbers reach the driver.
    """
    total, weights = found.agg(F.sum("n_candidates"), F.sum("weights")).first()
    if not total:
        return 1.0, math.inf
    c, weight = found.select(F.explode("found").alias("c")), weights / total
    steps = {r["step"]: r["n"] for r in c.groupBy(_step(F.col("c"), weight).alias("step")).agg(
        F.count("*").alias("n")).collect()}
    seen, limit = 0, math.inf
    for step in sorted(steps, reverse=True):
        seen += steps[step]
        if 10 ** (-step / STEPS) <= q * seen / total:
            limit = step
    return weight, limit


def _step(c: Column, weight: float) -> Column:
    """Number of whole steps below 1 of the weighted p-value: larger is more random."""
    p = F.least(F.lit(1.0), c["p"] * weight / _weight(c))
    return F.least(F.lit(STEPS * DEEPEST), F.floor(-F.log10(p) * STEPS))


def find_secrets(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``first, kind, last`` in code points, end exclusive.

    ``kind`` is a place in ``KINDS``. ``base``: fixed patterns. ``spans``: these and random strings, with a
    false discovery rate of at most ``q`` over all documents. Null and empty texts have none.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = stored(map_texts(source, ["doc_id", "text"], _scan, "doc_id bigint, "
                             "base array<struct<first:bigint,kind:int,last:bigint>>, "
                             "found array<struct<first:bigint,last:bigint,p:double>>, n_candidates bigint, weights double"), "secrets")
    weight, limit = discovery_limit(found, q)
    random = F.transform(F.filter("found", lambda c: _step(c, weight) >= F.lit(limit)), lambda c: F.struct(
        c["first"].alias("first"), F.lit(3).alias("kind"), c["last"].alias("last")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def spans_text(spans: str) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def count_kind(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
