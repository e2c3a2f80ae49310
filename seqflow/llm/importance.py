"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target text (documents
labelled good) and one of all text, give every document an importance weight: the ratio of
its probabilities under both, whose log is the sum of its n-grams' log ratios. Documents are sampled
without replacement in proportion to the weights: a Gumbel number is added to each log weight and the
k largest sums win. k is a share of all rows, or by default the number of documents whose mean log ratio clears
the cut that tells good and bad labels apart best. Where length must not decide, the log weight can
be ``sharpness`` times the mean log ratio instead.

The tables have a fixed size (2**bits buckets). The good and bad labels come from a sample of at
most ``sample`` labelled rows, smallest hashes first; the model of all text counts every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqflow.llm.ngram_join import mix
from seqflow.llm.rows import stored
from seqflow.llm.texts import Memo, map_texts, utf8

BITS = 16
SAMPLE = 20_000
SHARPNESS = 400.0
SMOOTHING = 1.0
PRIOR = 10  # n-grams of ratio 0 that every text is given, so that very short ones don't swing
BINS = 4096
SCORED = "doc_id bigint, n_grams bigint, ratio double, label int"
_TOKEN = re.compile(r"\w+|[^\w\s]+").findall


class Grams:
    """Buckets of the words, punctuation runs and their pairs in a text, lower-cased."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.hash = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode()))

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = _TOKEN(text.decode().lower())
        if not tokens:
            return np.empty(0, np.int64)
        ids = np.fromiter(map(self.hash.__getitem__, tokens), np.uint64, len(tokens))
        pairs = mix(ids[:-1] * np.uint64(3) + ids[1:])
        return (np.concatenate([mix(ids), pairs]) >> self.shift).astype(np.int64)


def label_sample(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> dict[int, int]:
    """At most ``sample`` labels by id. Null ids or labels and ids with contradicting labels don't count."""
    one = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("int").alias("q"))
    agreed = one.where("id IS NOT NULL AND q IS NOT NULL").groupBy("id").agg(
        F.min("q").alias("q"), F.max("q").alias("top")).where("q = top")
    picked = agreed.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "q")
    return {r["id"]: r["q"] for r in picked.collect()}


def fit(docs: DataFrame, known: dict[int, int], bits: int = BITS) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket. ``docs``: ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                at = grams(t)
                np.add.at(raw, at, 1)
                if shared.value.get(i) == 1:
                    np.add.at(target, at, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])

    counts = np.zeros((2, 1 << bits))
    parts = map_texts(docs, ["doc_id", "text"], count, "bucket int, raw bigint, target bigint")
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        counts[:, r["bucket"]] = r["raw"], r["target"]
    prob = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * (1 << bits))
    return np.log(prob[1]) - np.log(prob[0])


def ratios(docs: DataFrame, table: np.ndarray, known: dict[int, int]) -> DataFrame:
    """``doc_id, n_grams, ratio, label`` for ``doc_id, text``, and ``row`` as it came; a text without n-grams has ratio 0."""
    bits = int(table.size).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((table, known))
    carried = ["row"] if "row" in docs.columns else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        weights, labels = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [grams(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(g) for g in found], pa.int64()),
                pa.array([float(weights[g].sum() / (len(g) + PRIOR)) for g in found], pa.float64()),
                pa.array([labels.get(i) for i in ids], pa.int32()), *b.columns[2:]],
                ["doc_id", "n_grams", "ratio", "label", *carried])

    return map_texts(docs, ["doc_id", "text", *carried], score, SCORED + ", row bigint" * len(carried))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the gap between two scores with the best sum of both classes' hit rates; -inf without both classes."""
    good, bad = np.sort(scores[labels == 1]), np.sort(scores[labels != 1])
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(scores)
    gaps = np.concatenate([[values[0] - 1e-9], (values[1:] + values[:-1]) / 2])
    kept = 1 - np.searchsorted(good, gaps) / len(good)
    gone = np.searchsorted(bad, gaps) / len(bad)
    return float(gaps[np.argmax(kept + gone)])


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest number of a column, by counting ever narrower ranges; no sort, no collected column."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    wanted, part = k, df
    while True:
        width = (high - low) / BINS
        if not width > 0 or low + width == low:
            return high if wanted <= 1 else low
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col(value) - low) / width))
        seen = {r["bin"]: (r["n"], r["low"], r["high"]) for r in part.groupBy(bin_of.alias("bin")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()}
        for b in sorted(seen, reverse=True):
            n, low, high = seen[b]
            if wanted <= n:
                break
            wanted -= n
        if low == high:
            return low
        part = df.where((F.col(value) >= low) & (F.col(value) <= high))


def gumbel(seed: int, *by: str):
    """A standard Gumbel number from a hash of the columns ``by``, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(F.col, by)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
             sample: int = SAMPLE, sharpness: float | None = SHARPNESS, share: float | None = None, seed: int = 7,
             row_col: str | None = None) -> DataFrame:
    """``doc_id, n_grams, ratio, log_weight, gumbel_key, accepted, sampled`` for every row, and its ``row_col`` (a bigint) as ``row``.

    ``ratio``: mean log ratio. ``log_weight``: ``sharpness * ratio``, or the sum of log ratios if ``sharpness`` is None. ``accepted``: the
    ratio reaches the cut. ``sampled``: among the k largest keys, k being ``share`` of all rows (rounded up) or, without a
    share, the number of accepted rows; equal keys stand or fall together. Rows draw by their ``row_col``, else
    by id, n-gram count and ratio, so rows of one id (or none) draw apart and only rows that repeat an id and a text have one key. A
    null or empty text has ratio and log weight 0. Without labels of both kinds every row is accepted.
    """
    carried = [] if row_col is None else ["row"]
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         *[F.col(f"`{row_col}`").alias(c) for c in carried])
    known = label_sample(labels, sample)
    scored = stored(ratios(source, fit(source, known, bits), known), "ratios")
    seen = scored.where("label IS NOT NULL").select("ratio", "label").collect()  # labelled rows of the sample
    cut = best_cut(np.array([r["ratio"] for r in seen]), np.array([r["label"] for r in seen]))
    weight = F.col("ratio") * (F.col("n_grams") + PRIOR if sharpness is None else sharpness)
    draw = gumbel(seed, "doc_id", *(carried or ["n_grams", "ratio"]))
    keyed = scored.select("*", (F.col("ratio") >= F.lit(cut)).alias("accepted"), weight.alias("log_weight")).withColumn(
        "gumbel_key", F.col("log_weight") + draw)
    k = keyed.where("accepted").count() if share is None else math.ceil(share * keyed.count())
    last = kth_largest(keyed, "gumbel_key", k) if k else float("inf")
    return keyed.select("doc_id", "n_grams", "ratio", "log_weight", "gumbel_key", "accepted",
                        (F.col("gumbel_key") >= F.lit(last)).alias("sampled"), *carried)
