"""Selection campaign: rounds of evolve, clean, embed, search, rank, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.functions import sequences as S
from seqflow.operators import similarity as M, stats
from seqflow.operators.distance import nearest_distances
from seqflow.operators.embed import Predict
from seqflow.operators.guarded import failed_keys, guarded_rows
from seqflow.operators.ranking import distance_stats, select_most_distant
from seqflow.operators.rounds import previous_round_reference
from seqflow.plans.evolve import Proposer, Scorer, evolve, index_scorer, propose
from seqflow.session import materialize


@dataclass(frozen=True)
class Settings:
    """Campaign parameters and hooks.

    ``embed`` maps a sequence column to a vector column. ``model`` replaces it by a Python model (called
    once per task); a sequence it refuses fails its target, not the run. ``init`` makes the starting
    population of a round from ``(goal, <order>, seq)``, ``proposer`` the candidates of a step, ``scorer``
    the rewards from the index of the inputs.
    """

    rounds: int = 3
    steps: int = 3
    batch_size: int = 100
    num_sequences: int = 50
    num_mutations: int = 1
    topk: int = 10
    k: int = M.DEFAULT_K
    seed: int = 42
    score: str = "shared"
    embed: Callable[[str], Column] = S.composition
    model: Callable[[], Predict] | None = None
    init: Callable[[DataFrame, int], DataFrame] | None = None
    proposer: Proposer = propose
    scorer: Callable[[M.WordIndex], Scorer] | None = None


@dataclass
class Campaign:
    selected: DataFrame  # goal, round, seq_id, seq, embedding, pos, avg_rank, min_cos, min_l2
    records: DataFrame  # one row per generated sequence and round
    evaluations: DataFrame  # goal, round, embedding{...}, structure{...}
    failures: DataFrame  # goal, round, stage, n_failed, error: one row per failed target


def _embedded(rows: DataFrame, cfg: Settings) -> DataFrame:
    """``rows`` with ``embedding`` and ``error``."""
    if cfg.model is None:
        return rows.withColumn("embedding", cfg.embed("seq")).withColumn("error", F.lit(None).cast("string"))

    def apply():
        predict = cfg.model()

        def run(t: pa.Table) -> pa.Table:
            vectors = predict(np.asarray(t["seq"].to_pylist(), dtype=object))
            return pa.table({"embedding": pa.array(list(vectors), pa.list_(pa.float64()))})
        return run

    return guarded_rows(rows, "embedding array<double>", apply)


def _failed(rows: DataFrame, round_no: int, stage: str) -> DataFrame:
    return failed_keys(rows, ["goal"]).select("goal", F.lit(round_no).alias("round"), F.lit(stage).alias("stage"), "n_failed", "error")


def run_campaign(inputs: DataFrame, wild_type: Column, cfg: Settings = Settings(), order: str = "ord") -> Campaign:
    """``inputs`` is ``(goal, seq_id, <order>, seq)``. All targets advance together.

    A target whose inputs hold no letter, or with a sequence that the model refuses, leaves the campaign
    and becomes one row of ``failures``; the others go on. Empty inputs of other targets are left out.

    Round 1 starts from the inputs and ranks against them; later rounds start
    from, and rank against, the previous selection. Records always use the
    inputs.
    """
    by = ["goal"]
    filled = F.count_if(F.length("seq") > 0)
    failures = inputs.groupBy("goal").agg(F.count(F.lit(1)).alias("n_failed"), filled.alias("_n")).where("_n = 0").select(
        "goal", F.lit(0).alias("round"), F.lit("inputs").alias("stage"), "n_failed", F.lit("no sequences").alias("error"))
    given = inputs.where(F.length("seq") > 0).select("goal", "seq_id", order, "seq")
    base = materialize(_embedded(given, cfg), "inputs")
    bad = materialize(_failed(base, 0, "embed inputs"), "failures")
    failures = failures.unionByName(bad)
    base = base.join(bad, "goal", "left_anti").drop("error")
    length = stats.length_stats(base, by).select("goal", F.floor("q2").cast("int").alias("length"))
    length = materialize(length, "lengths")
    index = M.build_index(base, "seq_id", k=cfg.k, by=by, store=True)
    first_ref = base.select("goal", "seq_id", "embedding")

    scorer = index_scorer(index, cfg.score) if cfg.scorer is None else cfg.scorer(index)
    start, start_order = base, order
    selected = records = evaluations = None
    for r in range(1, cfg.rounds + 1):
        seeds = start if cfg.init is None else cfg.init(start.select("goal", start_order, "seq"), r)
        made = evolve(seeds, start_order, length, scorer, cfg.steps, cfg.batch_size, cfg.num_sequences,
                      cfg.num_mutations, cfg.seed, r, proposer=cfg.proposer)
        cut = made.join(length, "goal").select(
            "goal", "seq_id", F.substring("seq", F.lit(1), F.col("length")).alias("seq"))
        clean = stats.drop_invalid(cut)
        gen = materialize(_embedded(clean.where(F.length("seq") > 0).select("goal", "seq_id", "seq"), cfg), "generated")
        if cfg.model is not None:
            bad = materialize(_failed(gen, r, "embed"), "failures")
            failures = failures.unionByName(bad)
            gen = gen.join(bad, "goal", "left_anti")
        gen = gen.drop("error")

        hits = materialize(M.search(gen, index, "seq_id", few_queries=True), "hits")
        reference = previous_round_reference(
            first_ref, None if selected is None else selected.select("goal", "seq_id", "embedding", "round"))
        reference = reference.where(F.col("round") == r)
        dist = materialize(nearest_distances(gen, reference, "seq_id", by=by), "distances")
        top = select_most_distant(dist, cfg.topk, "seq_id", by)
        top = materialize(top.select("goal", F.lit(r).alias("round"), "seq_id", "seq", "embedding", "pos",
                                     "avg_rank", "min_cos", "min_l2"), "selected")

        to_inputs = nearest_distances(gen, first_ref, "seq_id", by=by)
        rec = M.round_records(gen, to_inputs, hits, wild_type, cfg.score, r, "seq_id", by=by)
        rec = materialize(rec, "records")

        embedding = distance_stats(top, by).select("goal", F.struct(
            "cosine_min", "cosine_max", "cosine_mean", "l2_min", "l2_max", "l2_mean").alias("embedding"))
        kept_hits = M.keep_listed(hits.withColumnRenamed("query", "seq_id"), top, "seq_id", by)
        structure = M.score_stats(kept_hits, cfg.score, by).select(
            "goal", F.struct(
                F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "mean").alias("structure"))
        ev = embedding.join(structure, "goal", "left").select("goal", F.lit(r).alias("round"), "embedding", "structure")

        selected = top if selected is None else selected.unionByName(top)
        records = rec if records is None else records.unionByName(rec)
        evaluations = ev if evaluations is None else evaluations.unionByName(ev)
        start, start_order = top, "pos"
    return Campaign(selected, records, evaluations, failures)
