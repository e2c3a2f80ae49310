"""Errors as rows, reruns of failed keys, failing targets, weighted parents."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqflow.operators.embed import composition_model
from seqflow.operators.guarded import failed_keys, guarded_groups, guarded_rows, with_reruns
from seqflow.plans.campaign import Settings, run_campaign
from seqflow.plans.evolve import OFFSETS, propose, propose_weighted


def local(make):
    """A copy that travels to the workers by value; they can't import this module."""
    return make()


@local
def halves():
    def make():
        def run(t: pa.Table) -> pa.Table:
            values = t["v"].to_pylist()
            if any(v % 7 == 0 for v in values):
                raise ValueError("seven")
            return pa.table({"half": pa.array([v / 2 for v in values])})
        return run
    return make


def test_one_bad_row_fails_alone(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1, 100)], "v long, k long").repartition(3)
    got = {r.v: (r.half, r.error) for r in guarded_rows(df, "half double", halves).collect()}
    assert got == {v: (None, "ValueError: seven") if v % 7 == 0 else (v / 2, None) for v in range(1, 100)}

    def broken():
        raise OSError("no model")
    out = guarded_rows(df, "half double", broken)
    assert out.where("error = 'OSError: no model' AND half IS NULL").count() == 99
    assert guarded_rows(df.where("false"), "half double", halves).count() == 0
    bad = {r.k: r.n_failed for r in failed_keys(guarded_rows(df, "half double", halves), ["k"]).collect()}
    assert sum(bad.values()) == 14


def test_failed_groups_are_rows_and_run_again_alone(spark, tmp_path):
    df = spark.createDataFrame([(k, i) for k in ("a", "b", "c", None) for i in range(5)], "k string, v long")
    log = str(tmp_path)

    def total(t: pa.Table) -> pa.Table:
        k = t["k"][0].as_py()
        name = f"{log}/{k}"
        with open(name, "a") as f:
            f.write("x")
        with open(name) as f:
            tries = len(f.read())
        if k == "b" or (k == "c" and tries < 2):
            raise RuntimeError(k)
        return pa.table({"s": pa.array([sum(t["v"].to_pylist())], pa.int64())})

    out = with_reruns(df, ["k"], lambda rows: guarded_groups(rows, ["k"], total, "s bigint"), attempts=3)
    assert {(r.k, r.s, r.error, r.attempt) for r in out.collect()} == {
        ("a", 10, None, 1), (None, 10, None, 1), ("c", 10, None, 2), ("b", None, "RuntimeError: b", 3)}
    tries = {p.name: len(p.read_text()) for p in tmp_path.iterdir()}
    assert tries == {"a": 1, "None": 1, "c": 2, "b": 3}


@local
def picky():
    def make():
        shares = composition_model()

        def predict(sequences):
            if any(set(s) == {"W"} for s in sequences):
                raise ValueError("only W")
            return shares(sequences)
        return predict
    return make


def test_campaign_goes_on_without_failed_targets(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKL"), n))
    rows = [("good", f"g{i}", i, word(40)) for i in range(8)] + [("good", "g8", 8, "")]
    rows += [("blank", f"b{i}", i, "") for i in range(3)] + [("refused", f"r{i}", i, "W" * 30) for i in range(2)]
    df = spark.createDataFrame(rows, "goal string, seq_id string, ord long, seq string")
    cfg = Settings(rounds=2, steps=1, batch_size=5, num_sequences=4, topk=2, k=3, model=picky)
    done = run_campaign(df, F.lit(rows[0][3]), cfg)
    assert {(r.goal, r["round"], r.n) for r in done.selected.groupBy("goal", "round").agg(F.count("*").alias("n")).collect()} == {
        ("good", 1, 2), ("good", 2, 2)}
    assert done.selected.where("length(seq) = 0").count() == 0
    assert {tuple(r) for r in done.failures.select("goal", "round", "stage", "n_failed", "error").collect()} == {
        ("blank", 0, "inputs", 3, "no sequences"), ("refused", 0, "embed inputs", 2, "ValueError: only W")}


def test_campaign_hooks_are_used(spark):
    rows = [("t", f"s{i}", i, "ACDEFGHIKL" * 3) for i in range(4)]
    df = spark.createDataFrame(rows, "goal string, seq_id string, ord long, seq string")
    seen = []

    def init(start, round_no):
        seen.append(round_no)
        return start.withColumn("seq", F.lit("CCCCCCCCCC"))

    def proposer(population, sizes, step, batch_size, *rest):
        seen.append("proposed")
        return propose(population, sizes, step, batch_size, *rest)

    def scorer(index):
        return lambda cand: cand.select("goal", F.col("id").alias("query"), F.lit(2.5).alias("avg_score"))

    cfg = Settings(rounds=1, steps=2, batch_size=3, num_sequences=2, topk=1, k=3, init=init, proposer=proposer, scorer=scorer)
    done = run_campaign(df, F.lit("A"), cfg)
    assert seen == [1, "proposed", "proposed"]
    assert done.selected.first()["seq"].count("C") >= 8


def test_parents_follow_their_rewards(spark):
    rewards = [0.0, 1.0, 3.0, 0.5, 10.0, 0.0]
    population = spark.createDataFrame([("g", i, "ACDEF", r) for i, r in enumerate(rewards)] + [("one", 0, "WWWWW", 0.0)],
                                       "goal string, pos long, seq string, reward float")
    population = population.withColumn("seq", F.concat("seq", F.col("pos").cast("string")))
    sizes = spark.createDataFrame([("g", 6), ("one", 1)], "goal string, n long")
    batch = 200
    rows = propose_weighted(population, sizes, 0, batch, 0, 7, 1).collect()
    assert sorted(r.i for r in rows if r.goal == "g") == list(range(batch)) == sorted(r.i for r in rows if r.goal == "one")
    weights = [round(r * 100) + 1 for r in rewards]
    for i, w in enumerate(weights):
        n = sum(r.goal == "g" and r.seq.endswith(str(i)) for r in rows)
        assert abs(n - batch * w / sum(weights)) < 1 + 1 / OFFSETS


@pytest.mark.parametrize("attempts", [1, 2])
def test_reruns_without_failures_run_once(spark, attempts):
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    runs = []

    def run(rows):
        runs.append(1)
        return guarded_rows(rows, "half double", halves)
    assert with_reruns(df, ["k"], run, attempts).count() == 1 and len(runs) == 1
