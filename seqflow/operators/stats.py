"""Length statistics and clean-up filters of sequence sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqflow.functions import sequences as S
from seqflow.operators.ordered import join_on


def median_length(seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
    """One row: the exact median length, floored."""
    return seqs.agg(F.floor(F.percentile(F.length(seq_col), F.lit(0.5))).cast("int").alias("median"))


def truncate_to(seqs: DataFrame, length: Column | int, seq_col: str = "seq") -> DataFrame:
    n = F.lit(length) if isinstance(length, int) else length
    return seqs.withColumn(seq_col, F.substring(F.col(seq_col), F.lit(1), n))


def drop_invalid(seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Keep sequences made of alphabet letters only."""
    return seqs.where(~S.has_invalid(seq_col))


def drop_oversize(seqs: DataFrame, budget: int, seq_col: str = "seq") -> DataFrame:
    """Drop sequences longer than the budget; equal length stays."""
    return seqs.where(F.length(seq_col) <= budget)


def length_stats(seqs: DataFrame, by: Sequence[str] = (), seq_col: str = "seq") -> DataFrame:
    """count, sum, min, mean, max, exact quartiles and N50 of the lengths.

    Everything runs on (key, length) counts, so the work after the first
    aggregation depends on distinct lengths, not on rows.
    """
    by = list(by)
    counts = seqs.groupBy(*by, F.length(seq_col).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    longest_first = W.partitionBy(*by).orderBy(F.col("len").desc())
    whole = W.partitionBy(*by)
    letters = F.col("len") * F.col("n")
    run = counts.select("*", F.sum(letters).over(longest_first).alias("_run"),
                        F.sum(letters).over(whole).alias("_all"))
    q = F.percentile(F.col("len"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    out = run.groupBy(*by).agg(
        F.sum("n").alias("num_seqs"), F.sum(letters).alias("sum_len"), F.min("len").alias("min_len"),
        (F.sum(letters) / F.sum("n")).alias("avg_len"), F.max("len").alias("max_len"), q.alias("_q"),
        F.max(F.when(F.col("_run") * 2 >= F.col("_all"), F.col("len"))).alias("n50"))
    return out.select(*by, "num_seqs", "sum_len", "min_len", "avg_len", "max_len",
                      F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"),
                      F.col("_q")[2].alias("q3"), "n50")


def pad_to_longest(seqs: DataFrame, by: Sequence[str] = (), seq_col: str = "seq") -> DataFrame:
    """Every sequence padded to the longest of its group, the length to use where none is given."""
    longest = seqs.groupBy(*by).agg(F.max(F.length(seq_col)).alias("_longest"))
    rows = join_on(seqs, longest, list(by), "inner") if by else seqs.withColumn("_longest", longest.scalar())
    return rows.withColumn(seq_col, S.fixed_length(seq_col, F.col("_longest"))).drop("_longest")
