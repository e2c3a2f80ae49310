"""Populations, batches, accounting, embedding, evolution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflow.functions import sequences as S
from seqflow.operators import accounting as A, batching as B, population as P, similarity as M
from seqflow.operators.embed import composition_model, embed_batches, embedding_udf, pool_tokens
from seqflow.plans.campaign import Settings, run_campaign
from seqflow.plans.embedding_job import embedding_job, job_metrics
from seqflow.plans.evolve import evolve, substitute


def test_best_n_and_report(spark):
    pop = spark.createDataFrame([("t", "AA", 0.0, 0), ("t", "AA", 2.0, 1), ("t", "CC", 2.0, 1), ("t", "DD", 1.0, 1), ("u", "EE", 0.0, 0)],
                                "goal string, seq string, reward double, batch_index int")
    best = P.best_n(pop, 2, ["goal"]).orderBy("goal", "pos").collect()
    assert [(r.goal, r.seq, r.reward) for r in best] == [("t", "AA", 2.0), ("t", "CC", 2.0), ("u", "EE", 0.0)]
    rep = {r.goal: r for r in P.batch_report(pop, ["goal"]).collect()}
    assert (rep["t"].batch_index, rep["t"].best_reward, rep["t"].population) == (1, 2.0, 4)
    assert rep["t"].mean_reward == pytest.approx(5 / 3)
    assert P.last_batch(pop, ["goal"]).count() == 4 and P.last_batch(pop).count() == 3


def test_fallback(spark):
    rows = spark.createDataFrame([("a", 1)], "g string, x int")
    spare = spark.createDataFrame([("a", 8), ("b", 9)], "g string, x int")
    assert {tuple(r) for r in P.with_fallback(rows, spare, ["g"]).collect()} == {("a", 1), ("b", 9)}
    assert P.with_fallback(rows, spare).count() == 1
    assert P.with_fallback(rows.limit(0), spare).count() == 2


def test_resample(spark):
    src = spark.createDataFrame([(i * 10, chr(65 + i)) for i in range(5)], "id long, seq string")
    big = P.resample_fill(src, "id", 23, seed=1).orderBy("pos").collect()
    assert [r.pos for r in big] == list(range(23)) and [r.seq for r in big[:5]] == list("ABCDE")
    assert {tuple(r) for r in P.resample_fill(src, "id", 23, seed=1).collect()} == {tuple(r) for r in big}
    assert [r.seq for r in P.resample_fill(src, "id", 3, seed=1).orderBy("pos").collect()] == list("ABC")
    assert P.resample_fill(src.limit(0), "id", 3, seed=1).count() == 0


def test_batches(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "id long, n int")
    kept = B.budget_cutoff(rows, "id", F.col("n"), 35, chunk_rows=3, max_chunks=4)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3]
    assert [r.slot for r in B.round_robin(rows, "id", 3, chunk_rows=3, max_chunks=4).orderBy("id").collect()] == [i % 3 for i in range(10)]
    assert [r.grp for r in B.fixed_groups(rows, "id", 4, chunk_rows=3, max_chunks=4).orderBy("id").collect()] == [i // 4 for i in range(10)]
    assert B.cycle(rows, 3).count() == 30 and B.replicate_batch(rows.limit(1), 7).count() == 7
    t = B.batch_totals(spark.createDataFrame([(0, 5), (0, 3), (1, 4)], "b int, n_tokens int"), ["b"]).orderBy("b").first()
    assert (t.n_seqs, t.n_tokens, t.width, t.padded, t.waste) == (2, 8, 5, 10, 0.2)
    asked = spark.createDataFrame([(1,), (1,), (99,)], "id long")
    assert sorted((r.id, r.found) for r in B.batch_payload(asked, rows, "id").collect()) == [(1, True), (1, True), (99, False)]
    assert [r.id for r in B.missing_batches(asked, rows, "id").collect()] == [99]


def test_interval_rates_skip_idle_lines(spark):
    log = spark.createDataFrame([("r", 10, 2, 20), ("r", 20, 2, 20), ("r", 30, 5, 50), ("q", 5, 1, 1)],
                                "run string, ts long, requests long, tokens long")
    got = {(r.run, r.ts): (r.d_requests, r.d_tokens, r.dt) for r in A.interval_rates(
        log, t_start=F.lit(0), chunk_rows=1, max_chunks=8).collect()}
    assert got == {("r", 10): (2, 20, 10.0), ("r", 30): (3, 30, 20.0), ("q", 5): (1, 1, 5.0)}


def test_interval_rates_over_chunks_read_their_input_twice_at_most(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for run in ("a", "b"):
        r = t = 0
        last, clock = (0, 0), None
        for ts in sorted(rng.sample(range(1000), 150)):
            if rng.random() < 0.4:
                r, t = r + rng.randrange(3), t + rng.randrange(2)
            rows.append((run, ts, r, t))
            if (r, t) != last:
                want[run, ts] = (r - last[0], t - last[1], None if clock is None else float(ts - clock))
                last, clock = (r, t), ts
    log = spark.createDataFrame(rows, "run string, ts long, requests long, tokens long").repartition(5)
    for chunk_rows in (7, 10**6):
        out = A.interval_rates(log, chunk_rows=chunk_rows)
        assert {(r.run, r.ts): (r.d_requests, r.d_tokens, r.dt) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("FileScan") <= 2


def test_in_flight_and_snapshot(spark):
    log = spark.createDataFrame([(0, 10, 5), (4, 6, 7), (10, 12, 1)], "a long, b long, tok long")
    got = {r.t: (r.in_flight, r.queue_tokens) for r in A.in_flight(log, "a", "b", "tok", chunk_rows=1, max_chunks=4).collect()}
    assert got == {0: (1, 5), 4: (2, 12), 6: (1, 5), 10: (1, 1), 12: (0, 0)}
    s = A.load_snapshot(log, F.lit(5), "a", "b", []).first()
    assert (s.total, s.busy, s.waiting, s.processed) == (3, 2, 1, 0)


def test_first_completion_and_timeouts(spark):
    done = spark.createDataFrame([(1, 9, "error"), (1, 5, "success"), (7, 1, "success")], "request_id long, at long, status string")
    asked = spark.createDataFrame([(1,), (2,)], "request_id long")
    assert {tuple(r) for r in A.match_requests(asked, done, "at", ["status"]).collect()} == {(1, 5, "success"), (2, None, None)}
    df = spark.createDataFrame([(5.0, 9.0), (9.5, 9.0), (7.0, 30.0)], "lat double, lim double")
    assert [r.x for r in df.select(A.timed_out(F.col("lat"), F.col("lim"), 6.0).alias("x")).collect()] == [False, True, True]


def test_outcomes_and_attempts(spark):
    res = spark.createDataFrame([("success", 0, "", 1), ("error", 2, "boom", 2), ("error", 1, "boom", 3)], "status string, retries int, message string, id int")
    r = A.outcome_rollup(res).first()
    assert (r.submitted, r.successful, r.failed, r.retries) == (3, 1, 2, 3)
    assert [(m.message, m.n) for m in A.error_messages(res, []).collect()] == [("boom", 2)]
    assert A.failed_targets(res, "message", "id").first().n_failed == 2
    att = spark.createDataFrame([(1, 1, "error"), (1, 2, "error"), (1, 3, "ok"), (2, 1, "ok")], "b int, attempt int, status string")
    got = {r.b: (r.status, r.retries, r.backoff) for r in A.fold_attempts(att, "b", "attempt", ["status"]).collect()}
    assert got == {1: ("ok", 2, 1.5), 2: ("ok", 0, 0.0)}


def test_scaling_and_steps(spark):
    runs = spark.createDataFrame([(1, 10, 10.0), (4, 30, 10.0)], "gpus int, n long, minutes double")
    got = {r.gpus: (r.speedup, r.efficiency) for r in A.scaling(runs).collect()}
    assert got == {1: (1.0, 1.0), 4: (3.0, 0.75)}
    log = spark.createDataFrame([("a", 3), ("a", 5), ("a", 9)], "k string, ts long")
    assert [(r.step, r.total) for r in A.step_times(log, "ts", ["k"], chunk_rows=1, max_chunks=4).orderBy("ts").collect()] == [(0, 0), (2, 2), (4, 6)]


def test_models(spark):
    model = composition_model()
    assert model(np.array(["AACD", ""], dtype=object))[0][:3].tolist() == [0.5, 0.25, 0.25]
    df = spark.createDataFrame([("ACDE",), ("YY",)], "seq string")
    got = df.select(embedding_udf()("seq").alias("v"), S.composition("seq").alias("w")).collect()
    assert all(r.v == r.w for r in got)
    t = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],), ([],)], "t array<array<double>>")
    assert [r.m for r in t.select(pool_tokens("t").alias("m")).collect()] == [[2.0, 4.0], None]


def test_model_sees_whole_batches(spark):
    """The model is called once per batch, even across Arrow batches."""
    rows = [("l", i // 30, i, "A" * (1 + i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "lane string, batch_no long, id long, seq string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = embed_batches(df, ["lane"], "id", make_predict_fn=lambda: lambda s: np.full((len(s), 1), float(len(s)))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.id: (r.seq_idx, r.embedding) for r in sizes} == {i: (i % 30, [30.0 if i < 90 else 10.0]) for i in range(100)}


def test_embedding_job(spark):
    rows = [("hot" if i % 3 else "cold", i, "ACDE" * (1 + i % 9)) for i in range(300)] + [("hot", 999, "A" * 101), ("hot", 998, "")]
    df = spark.createDataFrame(rows, "lane string, id long, seq string")
    stored = embedding_job(df, 100, ["lane"], "id", chunk_rows=40, max_chunks=8)
    got = stored.collect()
    assert sorted(r.id for r in got) == list(range(300))
    assert len({(r.lane, r.batch_no, r.seq_idx) for r in got}) == 300
    m = {r.lane: r for r in job_metrics(stored, ["lane"]).collect()}
    assert sum(r.sequences for r in m.values()) == 300
    assert sum(r.total_tokens for r in m.values()) == sum(len(s) + 2 for _, i, s in rows if i < 300)


def test_substitution_never_repeats_the_letter(spark):
    df = spark.range(200).select(S.hash32("a", F.col("id")).alias("d"), S.hash32("b", F.col("id")).alias("s"))
    out = df.select(substitute(F.lit("ACDEFGHIKL"), F.col("d"), F.col("s")).alias("x")).collect()
    for r in out:
        assert len(r.x) == 10 and sum(a != b for a, b in zip(r.x, "ACDEFGHIKL")) == 1
        assert set(r.x) <= set(S.ALPHABET)


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [("t1", i, f"in_{i}", "ACDEFGHIKLMNPQRSTVWY"[i % 5:] + "ACDACD") for i in range(20)]
    rows += [("t2", i, f"in_{i}", "WYWYKLMNP" + "ACDEF"[: 1 + i]) for i in range(4)]
    return spark.createDataFrame(rows, "goal string, ord long, seq_id string, seq string")


def test_evolve_invariants(spark, inputs, tmp_path):
    length = spark.createDataFrame([("t1", 12), ("t2", 10)], "goal string, length int")
    path = str(tmp_path / "pop")
    best = evolve(inputs, "ord", length, lambda cand: cand.select("goal", F.col("id").alias("query"), F.length("seq").cast("double").alias("avg_score")),
                  steps=3, batch_size=7, n=5, num_mutations=2, path=path).collect()
    pop = spark.read.parquet(path)
    sizes = {(r.goal, r.batch_index): r["count"] for r in pop.groupBy("goal", "batch_index").count().collect()}
    assert sizes == {("t1", 0): 20, ("t2", 0): 4, **{(g, b): 7 for g in ("t1", "t2") for b in (1, 2, 3)}}
    for g, n in (("t1", 41), ("t2", 25)):
        assert sorted(r.pos for r in pop.where(F.col("goal") == g).collect()) == list(range(n))
    assert {len(r.seq) for r in best if r.goal == "t1"} == {12}
    assert all(len({r.seq for r in best if r.goal == g}) == 5 for g in ("t1", "t2"))
    assert {r.reward for r in best} == {12.0, 10.0}


def test_campaign(spark, inputs):
    cfg = Settings(rounds=2, steps=1, batch_size=6, num_sequences=8, topk=3, k=3)
    c = run_campaign(inputs, F.lit("ACDEFGHIKL"), cfg)
    picked = c.selected.collect()
    assert {(r.goal, r.round, r.pos) for r in picked} == {(g, r, p) for g in ("t1", "t2") for r in (1, 2) for p in (1, 2, 3)}
    rec = c.records.collect()
    assert len({(r.goal, r.round, r.seq_id) for r in rec}) == len(rec) and all(r.substitutions is not None for r in rec)
    ev = c.evaluations.collect()
    assert len(ev) == 4 and all(
        r.embedding.l2_min - 1e-9 <= r.embedding.l2_mean <= r.embedding.l2_max + 1e-9 for r in ev)
