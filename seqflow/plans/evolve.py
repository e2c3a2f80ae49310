"""Evolution search: propose, score, append; then the best distinct sequences.

All targets are rows of one plan per step. Each step writes only its own batch
into the population folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from seqflow.functions.sequences import ALPHABET, fixed_length, hash32
from seqflow.operators import population as P, similarity as M
from seqflow.operators.ordered import ordinal, prefix_sums
from seqflow.session import materialize, scratch_path

Scorer = Callable[[DataFrame], DataFrame]
#: population, sizes, step, batch_size, num_mutations, seed, round_no -> (goal, i, id, seq)
Proposer = Callable[[DataFrame, DataFrame, int, int, int, int, int], DataFrame]
WEIGHT_UNITS = 100  # weights count hundredths of a reward
OFFSETS = 4096      # places where the comb of a weighted draw may start


def substitute(seq: Column, draw: Column, step: Column) -> Column:
    """Replace one residue, never by itself: position ``draw % length``, letter
    moved on by ``1 + step % 19`` places of the alphabet. An empty sequence stays."""
    pos = (draw % F.greatest(F.length(seq), F.lit(1))).cast("int")
    old = F.instr(F.lit(ALPHABET), F.substring(seq, pos + 1, F.lit(1))) - 1
    shift = (1 + step % (len(ALPHABET) - 1)).cast("int")
    new = F.substring(F.lit(ALPHABET), ((old + shift) % len(ALPHABET)) + 1, F.lit(1))
    return F.when(F.length(seq) > 0, F.overlay(seq, new, pos + 1, F.lit(1))).otherwise(seq)


def propose(population: DataFrame, sizes: DataFrame, step: int, batch_size: int, num_mutations: int,
            seed: int, round_no: int) -> DataFrame:
    """``batch_size`` mutants per target: ``(goal, i, id, seq)``.

    ``sizes`` is ``(goal, n)``. Parents are hashed positions, so this is an
    equi-join that matches one row each.
    """
    slots = sizes.select("goal", "n", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("i"))
    draw = [seed, round_no, step, F.col("goal"), F.col("i")]
    slots = slots.select("goal", "i", (hash32(*draw, "parent") % F.col("n")).alias("pos"))
    cand = slots.join(population.select("goal", "pos", "seq"), ["goal", "pos"])
    return _mutate(cand, step, num_mutations, seed, round_no)


def propose_weighted(population: DataFrame, sizes: DataFrame, step: int, batch_size: int, num_mutations: int,
                     seed: int, round_no: int) -> DataFrame:
    """As ``propose``, with parents drawn in proportion to their reward (plus a hundredth).

    Systematic sampling: a comb of ``batch_size`` even teeth with a hashed start is laid over the
    running sum of the weights, and a parent serves the teeth that fall on its own stretch. Its
    share differs from the expected one by less than one slot. The sums are a distributed scan; each
    row knows its teeth by itself, so nothing is collected and no slot looks for its parent.
    """
    weight = F.round(F.greatest(F.col("reward").cast("double"), F.lit(0.0)) * WEIGHT_UNITS).cast("bigint") + 1
    rows = population.select("goal", "pos", "seq", weight.alias("w"))
    placed = prefix_sums(rows, "pos", {"before": F.col("w")}, ["goal"])
    totals = rows.groupBy("goal").agg(F.sum("w").alias("total"))
    start = hash32(seed, round_no, step, F.col("goal"), "comb") % OFFSETS

    def tooth(reached: str) -> Column:
        """The first tooth at or behind a running sum."""
        at = F.expr(f"({reached} * {batch_size * OFFSETS}L + total - 1) div total")
        return F.greatest(F.lit(0), F.floor((at - F.col("start") + (OFFSETS - 1)) / OFFSETS)).cast("int")

    spread = placed.join(totals, "goal").withColumn("start", start)
    spread = spread.withColumn("first", tooth("before")).withColumn("last", F.least(tooth("(before + w)"), F.lit(batch_size)) - 1)
    cand = spread.where("first <= last").select("goal", F.explode(F.sequence("first", "last")).alias("i"), "seq")
    return _mutate(cand, step, num_mutations, seed, round_no)


def _mutate(cand: DataFrame, step: int, num_mutations: int, seed: int, round_no: int) -> DataFrame:
    draw = [seed, round_no, step, F.col("goal"), F.col("i")]
    for j in range(num_mutations):
        mutated = substitute(F.col("seq"), hash32(*draw, j, "pos"), hash32(*draw, j, "letter"))
        cand = cand.withColumn("seq", mutated)
    tag = F.format_string(f"cand_r{round_no}s{step}_%d", "i")
    return cand.select("goal", "i", tag.alias("id"), "seq")


def index_scorer(index: M.WordIndex, score: str = "shared") -> Scorer:
    """Default scorer: mean number of shared words with the target's inputs."""
    return lambda cand: M.mean_scores(M.search(cand, index, few_queries=True), score, ["goal"])


def evolve(start: DataFrame, order: str, length: DataFrame, scorer: Scorer, steps: int, batch_size: int,
           n: int, num_mutations: int = 1, seed: int = 42, round_no: int = 1,
           path: str | None = None, proposer: Proposer = propose) -> DataFrame:
    """``(goal, seq_id, seq, reward, pos)``: the ``n`` best distinct sequences.

    ``start`` is ``(goal, <order>, seq)``, ``length`` is ``(goal, length)``:
    every structure of a target has that length. If a target has no scored
    structure its first ``n`` starting ones stand in.
    """
    spark = start.sparkSession
    path = path or scratch_path(spark, "population")
    placed = ordinal(start.select("goal", F.col(order).alias("_at"), "seq"), "_at", ["goal"], "pos")
    fixed = placed.join(length, "goal").select(
        "goal", "pos", fixed_length("seq", F.col("length")).alias("seq"), F.lit(0.0).cast("float").alias("reward"))
    fixed.write.parquet(f"{path}/batch_index=0")
    # An explicit schema: a target set without candidates leaves an empty folder.
    schema = "goal string, pos bigint, seq string, reward float, batch_index int"

    def population() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    sizes = materialize(population().groupBy("goal").agg(F.count(F.lit(1)).alias("n")), "sizes")
    for step in range(steps):
        now = sizes.select("goal", (F.col("n") + step * batch_size).alias("n"))
        cand = materialize(proposer(population(), now, step, batch_size, num_mutations, seed, round_no), "candidates")
        scored = M.attach_scores(cand, scorer(cand), by=["goal"])
        batch = scored.join(now, "goal").select(
            "goal", (F.col("n") + F.col("i")).alias("pos"), "seq", "reward")
        batch.write.parquet(f"{path}/batch_index={step + 1}")
    best = P.best_n(population(), n, ["goal"])
    spare = population().where((F.col("batch_index") == 0) & (F.col("pos") < n)).select(
        "goal", "seq", "reward", (F.col("pos") + 1).cast("int").alias("pos"))
    rows = P.with_fallback(best.select("goal", "seq", "reward", "pos"), spare, ["goal"])
    name = F.format_string(f"gen_r{round_no}_%d", F.col("pos") - 1)
    return rows.select("goal", name.alias("seq_id"), "seq", "reward", "pos")
