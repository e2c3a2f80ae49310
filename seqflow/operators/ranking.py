"""Rank candidates by embedding distance and keep the most distant ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from seqflow.operators.distance import nearest_distances
from seqflow.operators.ordered import join_on, value_ranks
from seqflow.session import materialize


def average_ranks(dist: DataFrame, by: Sequence[str] = (), cos: str = "min_cos",
                  l2: str = "min_l2") -> DataFrame:
    """``(by..., cos, l2, avg_rank)``: mean of both descending ranks.

    One row per distinct distance pair, so copies of one candidate collapse
    before any ordering or join.
    """
    by = list(by)
    pairs = dist.groupBy(*by, cos, l2).agg(F.count(F.lit(1)).alias("_n"))
    by_cos = value_ranks(pairs, cos, by, F.col("_n"), descending=True, name="_rc")
    by_l2 = value_ranks(pairs, l2, by, F.col("_n"), descending=True, name="_rl")
    ranked = join_on(join_on(pairs, by_cos, [*by, cos]), by_l2, [*by, l2])
    return ranked.select(*by, cos, l2, ((F.col("_rc") + F.col("_rl")) / 2.0).alias("avg_rank"))


def select_most_distant(dist: DataFrame, k: int, id_col: str = "id", by: Sequence[str] = (),
                        cos: str = "min_cos", l2: str = "min_l2") -> DataFrame:
    """Top ``k`` per group by smallest average rank, ties by id; adds ``pos``.

    Candidates without reference distances are not ranked.
    """
    by = list(by)
    known = dist.where(F.col(cos).isNotNull() & F.col(l2).isNotNull())
    best = W.partitionBy(*by).orderBy("avg_rank")
    contenders = (average_ranks(known, by, cos, l2)
                  .withColumn("_r", F.rank().over(best)).where(F.col("_r") <= k).drop("_r"))
    rows = join_on(known, contenders, [*by, cos, l2], "inner")
    order = W.partitionBy(*by).orderBy("avg_rank", id_col)
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def most_distant(cand: DataFrame, ref: DataFrame, k: int, id_col: str = "id",
                 vec_col: str = "embedding", by: Sequence[str] = (), reduction: str = "min",
                 **options) -> DataFrame:
    """Distances, both ranks, their average, and the ``k`` best per group."""
    dist = nearest_distances(cand.select(*by, id_col, vec_col), ref, id_col, vec_col, by,
                             reduction, **options).drop(vec_col)
    return select_most_distant(materialize(dist, "distances"), k, id_col, by)


def distance_stats(dist: DataFrame, by: Sequence[str] = (), cos: str = "min_cos",
                   l2: str = "min_l2") -> DataFrame:
    """min / max / mean of the nearest distances of a selection."""
    return dist.groupBy(*by).agg(
        F.min(cos).alias("cosine_min"), F.max(cos).alias("cosine_max"), F.avg(cos).alias("cosine_mean"),
        F.min(l2).alias("l2_min"), F.max(l2).alias("l2_max"), F.avg(l2).alias("l2_mean"))
