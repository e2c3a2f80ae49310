"""Greedy packing: recorded values, brute force, busy lanes, carry-over."""

import random

import numpy as np
import pytest

from seqflow.operators.packing import apply_steps, compose_steps, pack, pack_with_state, transfer_steps

DEMO = ["STANHFNAYKLTRPYVAYCADCGMGHSCHSPAMIENIQADATDGTLK", "MKTFFVLLLAGAGAG", "MASQDVKIVVLGGLG",
        "MVHLTPEEKSAVTALWGKV"]
SMALL = {"chunk_rows": 60, "max_chunks": 12}


def greedy(rows, budget, state=None):
    out, state = {}, dict(state or {})
    for lane, i, n in sorted(rows, key=lambda r: (r[0], r[1])):
        if n > budget:
            continue
        used, no = state.get(lane, (0, 0))
        used, no = (n, no + 1) if used + n > budget else (used + n, no)
        state[lane] = (used, no)
        out[(lane, i)] = no
    return out, state


@pytest.mark.parametrize("budget,seqs,residues,tokens", [(20000, 832, 19968, 21632), (16000, 666, 15998, 17330)])
def test_recorded_first_batch(spark, budget, seqs, residues, tokens):
    rows = [(i, len(DEMO[i % 4])) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, n long")
    first = [r.n for r in pack(df, "id", "n", budget, **SMALL).where("batch_no = 0").collect()]
    assert (len(first), sum(first), sum(first) + 2 * len(first)) == (seqs, residues, tokens)


def test_transfer_function_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        budget = rng.randint(1, 30)
        sizes = [rng.randint(0, budget) for _ in range(rng.randint(1, 25))]
        froms, exits, opened = transfer_steps(np.array(sizes), budget)
        for u in range(budget + 1):
            i = int(np.searchsorted(froms, u, side="right")) - 1
            got = (u + exits[i] if opened[i] == 0 else exits[i], opened[i])
            used, no = u, 0
            for s in sizes:
                used, no = (s, no + 1) if used + s > budget else (used + s, no)
            assert got == (used, no)


@pytest.mark.parametrize("chunk_rows,max_chunks", [(60, 12), (10, 200), (10**6, 1)])
def test_busy_lane_equals_one_pass(spark, chunk_rows, max_chunks):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"l{rng.randrange(4)}", i, rng.choice([0, 1, 5, 60, 99, 100, 101, 300]))
            for i in rng.sample(range(10**6), 1500)]
    df = spark.createDataFrame(rows, "lane string, id long, n long")
    got = pack(df, "id", "n", 100, ["lane"], chunk_rows=chunk_rows, max_chunks=max_chunks).collect()
    assert {(r.lane, r.id): r.batch_no for r in got} == greedy(rows, 100)[0]
    sums = {}
    for r in got:
        sums[(r.lane, r.batch_no)] = sums.get((r.lane, r.batch_no), 0) + r.n
    assert max(sums.values()) <= 100


def test_carry_continues_open_batches(spark):
    rng = random.Random(6)
    rows = [(f"l{rng.randrange(3)}", i, rng.randint(1, 40)) for i in range(600)]
    a, b = rows[:250], rows[250:]
    schema = "lane string, id long, n long"
    first, state = pack_with_state(spark.createDataFrame(a, schema), "id", "n", 100, ["lane"], **SMALL)
    second, final = pack_with_state(spark.createDataFrame(b, schema), "id", "n", 100, ["lane"], state, **SMALL)
    got = {(r.lane, r.id): r.batch_no for r in first.unionByName(second).collect()}
    want, end = greedy(rows, 100)
    assert got == want
    assert {r.lane: (r.used, r.batch_no) for r in final.collect()} == end


def test_length_equal_to_budget_stays(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, 1)], "id long, n long")
    assert {r.id: r.batch_no for r in pack(df, "id", "n", 10).collect()} == {1: 0, 3: 1}


def test_composition_equals_one_pass():
    rng = random.Random(2)
    for _ in range(300):
        budget = rng.randint(1, 30)
        parts = [[rng.randint(0, budget) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        fs = [transfer_steps(np.array(p, np.int64), budget) for p in parts]
        left = compose_steps(compose_steps(fs[0], fs[1], budget), fs[2], budget)
        right = compose_steps(fs[0], compose_steps(fs[1], fs[2], budget), budget)
        whole = transfer_steps(np.array(sum(parts, []), np.int64), budget)
        for u in range(budget + 1):
            assert apply_steps(left, u) == apply_steps(right, u) == apply_steps(whole, u)


def test_many_parts_in_a_deep_tree(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.8 else f"l{rng.randrange(3)}", i, rng.choice([0, 3, 40, 99, 100])) for i in range(700)]
    df = spark.createDataFrame(rows, "lane string, id long, n long").repartition(7)
    carry = spark.createDataFrame([("hot", 97, 5)], "lane string, used long, batch_no long")
    packed, state = pack_with_state(df, "id", "n", 100, ["lane"], carry, chunk_rows=10, fan=3)
    want, end = greedy(rows, 100, {"hot": (97, 5)})
    assert {(r.lane, r.id): r.batch_no for r in packed.collect()} == want
    assert {r.lane: (r.used, r.batch_no) for r in state.collect()} == end


@pytest.mark.parametrize("task_rows,most", [(50_000, 1), (150, 5)])
def test_small_parts_share_tasks(spark, monkeypatch, task_rows, most):
    from seqflow.operators import packing as P
    stored, keep = {}, P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: stored.setdefault(name, df) and keep(df, name))
    monkeypatch.setattr(P, "TASK_ROWS", task_rows, raising=False)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"l{rng.randrange(3)}", i, rng.choice([0, 3, 40, 99, 100])) for i in range(700)]
    df = spark.createDataFrame(rows, "lane string, id long, n long")
    got = pack(df, "id", "n", 100, ["lane"], chunk_rows=10, fan=3)
    assert {(r.lane, r.id): r.batch_no for r in got.collect()} == greedy(rows, 100)[0]
    assert stored["parts"].rdd.getNumPartitions() <= most  # 70 parts
