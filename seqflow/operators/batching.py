"""Batch bookkeeping: cut-off, assignment, payload lookup, padding, replication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqflow.operators.ordered import join_on, ordinal, prefix_sums


def budget_cutoff(rows: DataFrame, order: str, size: Column, budget: int, by: Sequence[str] = (),
                  **chunking) -> DataFrame:
    """Keep rows in order until their running total has passed ``budget``.

    The row that crosses the line is kept. Adds ``seen``, the total before it.
    """
    run = prefix_sums(rows, order, {"seen": size.cast("bigint")}, by, **chunking)
    return run.where(F.col("seen") <= budget)


def round_robin(rows: DataFrame, order: str, n: int, by: Sequence[str] = (), name: str = "slot",
                **chunking) -> DataFrame:
    """Deal rows to ``n`` slots in turn."""
    placed = ordinal(rows, order, by, "_ord", **chunking)
    return placed.withColumn(name, (F.col("_ord") % n).cast("int")).drop("_ord")


def fixed_groups(rows: DataFrame, order: str, n: int, by: Sequence[str] = (), name: str = "grp",
                 **chunking) -> DataFrame:
    """Consecutive groups of ``n`` rows."""
    placed = ordinal(rows, order, by, "_ord", **chunking)
    return placed.withColumn(name, F.floor(F.col("_ord") / n)).drop("_ord")


def cycle(rows: DataFrame, times: int) -> DataFrame:
    """Repeat the whole source ``times`` times; order by ``(cycle, ...)``."""
    return rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def replicate_batch(batch: DataFrame, num_batches: int) -> DataFrame:
    """One shared batch under ``num_batches`` ids."""
    return batch.withColumn("batch_id", F.explode(F.sequence(F.lit(0), F.lit(num_batches - 1))))


def batch_totals(tokens: DataFrame, by: Sequence[str], n_tokens: str = "n_tokens") -> DataFrame:
    """Sequences, tokens, padded width and padding waste per batch.

    A batch holds at most a budget's worth of rows, so the groups are small.
    """
    t = F.col(n_tokens)
    out = tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(t).cast("bigint").alias("n_tokens"),
                                  F.max(t).cast("int").alias("width"))
    cells = F.col("n_seqs") * F.col("width")
    return (out.withColumn("padded", cells)
            .withColumn("waste", (cells - F.col("n_tokens")) / cells))


def batch_payload(requests: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """Look each requested batch up; ``found`` is false for an unknown id."""
    known = batches.withColumn("_hit", F.lit(True))
    out = join_on(requests, known, [key])
    return out.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing_batches(requests: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    return requests.join(batches.select(key), key, "left_anti")
