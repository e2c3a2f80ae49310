"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqflow.llm.rows import stored

MAX_ROUNDS = 60  # the number of rounds grows with the logarithm of a component's size


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: the smallest id reachable, for every id on an edge.

    Each round hangs neighbours on their smallest neighbour, first those above a vertex, then those
    below. Minima are aggregated ahead of the shuffle and joined back, so no neighbourhood is ever
    collected; every round is stored and cuts the lineage. Self-loops and null ids are ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = stored(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
                        "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        pairs = stored(_small_star(_large_star(pairs)), "edges")
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the smallest of its neighbours and itself."""
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    up = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every vertex hands its smaller neighbours, and itself, to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u")
    hung = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        moved.select("u", F.col("m").alias("v")))
    return hung.where("u != v").distinct()
