"""Batch embedding: filter, pack, run the model per batch, store, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from seqflow.functions import sequences as S
from seqflow.operators.embed import composition_model, embed_batches, embed_tokens, letter_model, truncate
from seqflow.operators.packing import pack
from seqflow.sources.embeddings import read_embeddings, write_embeddings


def embedding_job(seqs: DataFrame, budget: int, by: Sequence[str], order: str, seq_col: str = "seq",
                  make_predict_fn: Callable = composition_model, path: str | None = None,
                  max_tokens: int = S.MAX_TOKENS, **packing) -> DataFrame:
    """Embed ``seqs`` in token-budget batches per lane; returns the stored rows.

    Packing moves only ids and lengths; the text is shuffled once, to its batch. The model sees what
    fits ``max_tokens``, start and end token included; ``n_tokens`` counts the same tokens.
    """
    by = list(by)
    plan = _plan(seqs, budget, by, order, seq_col, packing)
    rows = seqs.select(order, truncate(seq_col, max_tokens).alias(seq_col)).join(plan.select(*by, order, "batch_no"), order)
    vectors = embed_batches(rows, by, order, seq_col, make_predict_fn)
    tokens = plan.select(order, F.least(F.col("n") + S.SPECIAL_TOKENS, F.lit(max_tokens)).cast("int").alias("n_tokens"))
    return read_embeddings(seqs.sparkSession, write_embeddings(vectors.join(tokens, order), path))


def token_job(seqs: DataFrame, budget: int, by: Sequence[str], order: str, seq_col: str = "seq",
              make_predict_fn: Callable = letter_model, path: str | None = None, max_tokens: int = S.MAX_TOKENS,
              part_bytes: int | None = None, **packing) -> DataFrame:
    """As ``embedding_job``, but a vector for every token: the stored ``(lane, batch_no, seq_idx, part)`` rows.

    Only what the model sees of a sequence travels to its batch, and vectors are written as they come.
    """
    by = list(by)
    plan = _plan(seqs, budget, by, order, seq_col, packing)
    rows = seqs.select(order, truncate(seq_col, max_tokens).alias(seq_col)).join(plan.select(*by, order, "batch_no"), order)
    parts = {} if part_bytes is None else {"part_bytes": part_bytes}
    tokens = embed_tokens(rows, by, order, seq_col, make_predict_fn, max_tokens, **parts)
    return read_embeddings(seqs.sparkSession, write_embeddings(tokens, path, folders=False))


def rejected_rows(seqs: DataFrame, budget: int, keys: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """``keys..., n, reason`` of the rows that the jobs don't embed: above the budget, empty or null."""
    n = F.length(seq_col)
    reason = F.when(n.isNull(), "null").when(n == 0, "empty").when(n > budget, "oversize")
    return seqs.select(*keys, n.alias("n"), reason.alias("reason")).where("reason IS NOT NULL")


def _plan(seqs: DataFrame, budget: int, by: list[str], order: str, seq_col: str, packing: dict) -> DataFrame:
    lengths = seqs.select(*by, order, F.length(seq_col).alias("n"))
    # Empty rows never change a batch, so they can go after packing.
    return pack(lengths, order, "n", budget, by, **packing).where(F.col("n") > 0)


def job_metrics(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Requests (batches), sequences and tokens per lane, from the stored rows."""
    per_batch = stored.groupBy(*by, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tok"))
    return per_batch.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum("n").alias("sequences"),
                                      F.sum("tok").cast("bigint").alias("total_tokens"))
