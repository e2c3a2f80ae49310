"""Sets of scored samples: filling, de-duplication, best n, fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from seqflow.functions.sequences import hash32
from seqflow.operators.ordered import join_on, ordinal


def resample_fill(rows: DataFrame, order: str, size: int, seed: int, **chunking) -> DataFrame:
    """Exactly ``size`` rows: the input in order, then hashed picks from it.

    Adds ``pos``. The picks are an equi-join on the position drawn by a hash,
    each matching one row.
    """
    placed = ordinal(rows, order, name="pos", **chunking)
    n = rows.count()
    if n == 0:
        return placed
    if n >= size:
        return placed.where(F.col("pos") < size)
    draws = rows.sparkSession.range(n, size).select(
        F.col("id").alias("_at"), (hash32(seed, F.col("id")) % n).alias("pos"))
    extra = placed.join(draws, "pos").drop("pos").withColumnRenamed("_at", "pos")
    return placed.unionByName(extra)


def append_batch(population: DataFrame, scored: DataFrame, batch_index: int) -> DataFrame:
    """Union of the population and newly scored samples."""
    return population.unionByName(scored.withColumn("batch_index", F.lit(batch_index)))


def last_batch(population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the newest batch of each group."""
    by = list(by)
    newest = population.groupBy(*by).agg(F.max("batch_index").alias("_last"))
    if not by:
        return population.where(F.col("batch_index") == newest.scalar())
    return (join_on(population, newest, by, "inner")
            .where(F.col("batch_index") == F.col("_last")).drop("_last"))


def batch_report(population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best and mean reward of the newest batch, and the population size.

    One aggregation to (group, batch), then one row per group.
    """
    by = list(by)
    per_batch = population.groupBy(*by, "batch_index").agg(
        F.max("reward").alias("best"), F.avg("reward").alias("mean"), F.count(F.lit(1)).alias("n"))
    return per_batch.groupBy(*by).agg(
        F.max("batch_index").alias("batch_index"), F.max_by("best", "batch_index").alias("best_reward"),
        F.max_by("mean", "batch_index").alias("mean_reward"),
        F.sum("n").alias("population"))


def best_n(population: DataFrame, n: int, by: Sequence[str] = (), seq_col: str = "seq") -> DataFrame:
    """The ``n`` best distinct sequences; a sequence keeps its best reward.

    Copies merge map-side; the rank filter then keeps ``n`` rows per task
    before anything is shuffled by group.
    """
    by = list(by)
    distinct = population.groupBy(*by, seq_col).agg(F.max("reward").alias("reward"))
    order = W.partitionBy(*by).orderBy(F.col("reward").desc(), seq_col)
    return distinct.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def with_fallback(rows: DataFrame, fallback: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows``, or for every group that has none the rows of ``fallback``."""
    by = list(by)
    if by:
        present = rows.select(*by).distinct()
        spare = join_on(fallback, present, by, "left_anti")
    else:
        empty = rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("e"))
        spare = fallback.where(empty.scalar())
    return rows.unionByName(spare)
