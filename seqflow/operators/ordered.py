"""Order-dependent operators without an unpartitioned window.

A running value over one long order would pull everything into one task. Here
rows are dealt by ranges of the order column to chunks of consecutive values, of
about as many rows each even when one key owns most of the table. The window runs
inside ``(key, chunk)``; a small table with one row per ``(key, chunk)`` carries
totals, last and first values across chunks. The number of chunks has no bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqflow.session import materialize

CHUNK = "_chunk"
CHUNK_ROWS = 50_000


def chunked(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS, max_chunks: int | None = None) -> DataFrame:
    """``df``, stored, with the number of each row's chunk.

    Equal order values share a chunk; nulls are in the first, NaN in the last. ``df`` is read once;
    counting, range bounds and scans read what was stored, and chunk numbers are stored with the rows,
    so a retried task sees the same ones. ``max_chunks`` bounds the number of chunks only if given.
    """
    rows = materialize(df, "ordered")
    chunks = -(-rows.count() // chunk_rows)
    if max_chunks is not None:
        chunks = min(chunks, max_chunks)
    if chunks <= 1:
        return rows.withColumn(CHUNK, F.lit(0))
    dealt = rows.repartitionByRange(chunks, order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(dealt, "chunks")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys; keeps the left copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def ordered_scan(df: DataFrame, order: str, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None,
                 lags: Mapping[str, str] | None = None, firsts: Mapping[str, str] | None = None, **chunking) -> DataFrame:
    """Add running values per ``by`` in ``order``, all from one chunking, one sort and one bundle of carries.

    ``sums``: the sum of a value over all earlier rows, 0 on the first. ``lags``: a column's value on the
    row ahead, null on the first. ``firsts``: a column's value on the first row. ``order`` must be a
    unique number within ``by``.
    """
    by, sums, lags, firsts = list(by), sums or {}, lags or {}, firsts or {}
    parts = chunked(df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()]), order, **chunking)
    keys = [*by, CHUNK]
    here = W.partitionBy(*keys).orderBy(order)
    before, at = here.rowsBetween(W.unboundedPreceding, -1), F.struct(order)  # in a struct, a null order counts too
    local = [F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_l_{n}") for n in sums]
    totals = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    # One row per (key, chunk).
    chunks = W.partitionBy(*by).orderBy(CHUNK)
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    added = [(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    if lags:
        values = F.struct(*[F.col(c).alias(n) for n, c in lags.items()])
        local += [F.lag(values).over(here).alias("_prev"), F.row_number().over(here).alias("_rn")]
        totals.append(F.max_by(values, at).alias("_last"))
        carry.append(F.lag("_last").over(chunks).alias("_carry"))
        picked = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
        added += [picked[n].alias(n) for n in lags]
    if firsts:
        totals.append(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in firsts.items()]), at).alias("_first"))
        carry.append(F.first("_first").over(chunks).alias("_start"))
        added += [F.col("_start")[n].alias(n) for n in firsts]
    edges = parts.groupBy(*keys).agg(*totals).select(*keys, *carry)
    return join_on(parts.select(*df.columns, CHUNK, *local), edges, keys).select(*df.columns, *added)


def prefix_sums(df: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = (), **chunking) -> DataFrame:
    """Add, per ``by`` in ``order``, the sum of each value over all earlier rows; 0 on the first row."""
    return ordered_scan(df, order, by, sums=sums, **chunking)


def ordinal(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "ord",
            **chunking) -> DataFrame:
    """Add the 0-based position of each row within ``by``."""
    return prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, by, **chunking)


def previous(df: DataFrame, order: str, cols: Mapping[str, str], by: Sequence[str] = (),
             **chunking) -> DataFrame:
    """Add the value of each column on the preceding row (null on the first row)."""
    return ordered_scan(df, order, by, lags=cols, **chunking)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None,
                descending: bool = False, name: str = "rank", **chunking) -> DataFrame:
    """SQL ``rank()`` of every distinct value: ``(by..., value, rank)``.

    Equal values are counted before anything is ordered, so a value shared by
    most rows costs one row here.
    """
    by = list(by)
    n = F.lit(1) if weight is None else weight
    counts = df.groupBy(*by, value).agg(F.sum(n).cast("bigint").alias("_n"))
    keyed = counts.withColumn("_key", -F.col(value) if descending else F.col(value))
    ranked = prefix_sums(keyed, "_key", {"_before": F.col("_n")}, by, **chunking)
    return ranked.select(*by, value, (F.col("_before") + 1).alias(name))
