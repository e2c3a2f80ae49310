"""The model surface: pluggable batch predictors and a built-in encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqflow.functions.sequences import ALPHABET, END_ID, MAX_TOKENS, SPECIAL_TOKENS
from seqflow.operators.segments import segment_bounds

Predict = Callable[[np.ndarray], np.ndarray]
TokenPredict = Callable[[np.ndarray], list[np.ndarray]]
PART_BYTES = 1 << 20   # of one row of token vectors
OUT_BYTES = 8 << 20    # of one record batch of such rows


def composition_model() -> Predict:
    """Built-in encoder: the share of each letter. Called once per worker."""
    codes = np.frombuffer(ALPHABET.encode("ascii"), dtype=np.uint8)

    def predict(seqs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(seqs), len(codes)))
        for i, s in enumerate(seqs):
            raw = np.frombuffer(s.encode("ascii"), dtype=np.uint8)
            out[i] = np.bincount(raw, minlength=128)[codes] / max(1, len(raw))
        return out

    return predict


def letter_model() -> TokenPredict:
    """Built-in token encoder: per token its id, the next one's, its place and whether it ends the sequence.

    Gives a row for each letter and for the end token; the start token is left out.
    """
    ids = np.zeros(128, np.int64)
    ids[np.frombuffer(ALPHABET.encode("ascii"), np.uint8)] = np.arange(len(ALPHABET))

    def predict(seqs: np.ndarray) -> list[np.ndarray]:
        out = []
        for s in seqs:
            code = np.append(ids[np.frombuffer(s.encode("ascii"), np.uint8)], END_ID)
            place = np.arange(len(code))
            out.append(np.stack([code / 32, np.append(code[1:], 0) / 32, place / 1024, place == len(code) - 1], axis=1))
        return out

    return predict


def truncate(seq: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """What a model of ``max_tokens`` tokens sees of a sequence: start and end token count too."""
    return F.substring(F.col(seq) if isinstance(seq, str) else seq, 1, max_tokens - SPECIAL_TOKENS)


def embedding_udf(make_predict_fn: Callable[[], Predict] = composition_model, batch_size: int = 256):
    """A column function ``seq -> array<double>``; the model loads once per worker."""
    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)


def embed_batches(packed: DataFrame, by: Sequence[str], order: str, seq_col: str = "seq",
                  make_predict_fn: Callable[[], Predict] = composition_model) -> DataFrame:
    """Run the model on exactly the given batches.

    Adds ``seq_idx`` and ``embedding`` to ``(by..., batch_no, order)``. A batch
    is bounded by its token budget; partitions are hashed by batch, so one busy
    lane spreads over all tasks.
    """
    keys = [*by, "batch_no"]
    return _run_batches(packed, keys, order, seq_col, make_predict_fn, _predict, "seq_idx int, embedding array<double>")


def embed_tokens(packed: DataFrame, by: Sequence[str], order: str, seq_col: str = "seq",
                 make_predict_fn: Callable[[], TokenPredict] = letter_model, max_tokens: int = MAX_TOKENS,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """One vector per token, from a model that returns a ``tokens x dim`` array for each sequence.

    Adds ``seq_idx, part, start, vectors`` to ``(by..., batch_no, order)``. A sequence's rows are split
    into parts of at most ``part_bytes``, counted from ``part`` 0 with the place of their first token in
    ``start``, so neither a row nor a record batch grows with the length of a sequence. Sequences are
    cut to what fits ``max_tokens`` ahead of the model; ``pool_parts`` joins parts again.
    """
    def emit(t: pa.Table, keys: list[str], cols: list[str], seq_col: str, model: TokenPredict):
        bounds = segment_bounds(t, keys)
        for a, b in zip(bounds, bounds[1:]):
            yield from _token_parts(t.slice(a, b - a), cols, model(_sequences(t, seq_col, a, b)), part_bytes)

    cut = packed.withColumn(seq_col, truncate(seq_col, max_tokens))
    return _run_batches(cut, [*by, "batch_no"], order, seq_col, make_predict_fn, emit,
                        "seq_idx int, part int, start int, vectors array<array<double>>")


def _token_parts(t: pa.Table, cols: list[str], outputs: list[np.ndarray], part_bytes: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        of, part, start, pieces = zip(*rows)
        lengths = np.array([len(p) for p in pieces])
        flat = np.concatenate(pieces)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), inner)
        out = t.select(cols).take(pa.array(of))
        for name, v in (("seq_idx", of), ("part", part), ("start", start)):
            out = out.append_column(name, pa.array(v, pa.int32()))
        rows.clear()
        return out.append_column("vectors", vectors).combine_chunks().to_batches()[0]

    for i, vectors in enumerate(outputs):
        vectors = np.asarray(vectors, np.float64)
        step = max(1, part_bytes // max(8, 8 * vectors.shape[1]))
        for part, start in enumerate(range(0, max(1, len(vectors)), step)):
            piece = vectors[start:start + step]
            rows.append((i, part, start, piece))
            held += piece.nbytes
            if held >= OUT_BYTES:
                yield flush()
                held = 0
    if rows:
        yield flush()


def _run_batches(packed: DataFrame, keys: list[str], order: str, seq_col: str, make_fn: Callable, emit: Callable,
                 added: str) -> DataFrame:
    """Hand whole batches, one after another, to ``emit`` with a model that is loaded once per task."""
    cols = [*keys, order]
    fields = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in cols) + f", {added}"

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_fn()
        held: pa.Table | None = None
        for batch in tables:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = segment_bounds(held, keys)[-2]
            if last:  # every batch but the last one is complete
                yield from emit(held.slice(0, last), keys, cols, seq_col, model)
                held = held.slice(last)
        if held is not None:
            yield from emit(held, keys, cols, seq_col, model)

    ordered = packed.select(*cols, seq_col).repartition(*keys).sortWithinPartitions(*keys, order)
    return ordered.mapInArrow(run, schema)


def _sequences(t: pa.Table, seq_col: str, a: int, b: int) -> np.ndarray:
    return np.asarray(t[seq_col].slice(a, b - a).to_pylist(), dtype=object)


def _predict(t: pa.Table, keys: list[str], cols: list[str], seq_col: str, model: Predict):
    bounds = segment_bounds(t, keys)
    for a, b in zip(bounds, bounds[1:]):
        part = t.slice(a, b - a)
        vectors = model(_sequences(t, seq_col, a, b))
        out = part.select(cols).append_column("seq_idx", pa.array(np.arange(b - a, dtype=np.int32)))
        lists = pa.array(list(vectors), pa.list_(pa.float64()))
        yield from out.append_column("embedding", lists).to_batches()


def pool_tokens(tokens: Column | str) -> Column:
    """Mean of token vectors (``array<array<double>>``); null for no tokens."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    total = F.aggregate(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), t[0],
                        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.when(F.size(t) > 0, F.transform(total, lambda x: x / F.size(t)))


def _add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def pool_parts(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., n_rows, embedding``: the mean token vector of each sequence stored in parts.

    A part is summed where it lies; a sequence then has a few sums, added in the order of its parts.
    """
    v = F.col("vectors")
    first = F.when(F.size(v) > 0, v[0])
    total = F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), first, _add)
    sums = tokens.select(*keys, F.struct("part", total.alias("total"), F.size(v).alias("n")).alias("_p"))
    parts = sums.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    rest = F.slice("_ps", F.lit(2), F.size("_ps") - 1)
    whole = F.aggregate(rest, F.col("_ps")[0]["total"], lambda acc, p: _add(acc, p["total"]))
    n = F.aggregate("_ps", F.lit(0), lambda acc, p: acc + p["n"])
    return parts.select(*keys, n.alias("n_rows"), F.transform(whole, lambda x: x / n).alias("embedding"))
