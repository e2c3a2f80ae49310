"""Distances and ranking: every strategy against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflow.functions import vectors as V
from seqflow.operators import distance as D
from seqflow.operators.distance import nearest_distances, pair_distances
from seqflow.operators.ranking import most_distant


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    cand = rng.normal(size=(120, 6))
    cand[40:80] = cand[0]  # a third are copies
    ref = rng.normal(size=(30, 6))
    ref[:10] = ref[0]
    return cand, ref


def frame(spark, m, groups):
    rows = [(i, f"g{i % groups}", [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, g string, embedding array<double>")


def brute(cand, ref, groups, reduce):
    out = {}
    for i, a in enumerate(cand):
        r = np.array([b for j, b in enumerate(ref) if j % groups == i % groups])
        cos = 1 - r @ a / np.linalg.norm(r, axis=1) / np.linalg.norm(a)
        l2 = np.linalg.norm(r - a, axis=1)
        out[i] = (reduce(cos), reduce(l2))
    return out


@pytest.mark.parametrize("reduction", ["min", "mean"])
@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "block_rows": 7}])
@pytest.mark.parametrize("groups", [1, 3])
def test_nearest(spark, data, reduction, options, groups):
    cand, ref = data
    got = nearest_distances(frame(spark, cand, groups), frame(spark, ref, groups), by=["g"],
                            reduction=reduction, **options).collect()
    want = brute(cand, ref, groups, np.min if reduction == "min" else np.mean)
    assert len(got) == len(cand)
    for r in got:
        assert (r.min_cos, r.min_l2) == pytest.approx(want[r.id], abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0}])
def test_group_without_reference_is_null(spark, data, options):
    cand, ref = data
    got = nearest_distances(frame(spark, cand, 2), frame(spark, ref, 1), by=["g"], **options)
    assert got.where("min_cos IS NULL").count() == 60 and got.count() == 120


def test_small_distance_keeps_digits(spark):
    a = spark.createDataFrame([(1, [1e3, 1e3 + 1e-7])], "id long, embedding array<double>")
    b = spark.createDataFrame([(1, [1e3, 1e3])], "id long, embedding array<double>")
    assert nearest_distances(a, b).first().min_l2 == pytest.approx(1e-7, rel=1e-3)


def test_pairs_and_expressions(spark, data):
    cand, ref = data
    pairs = pair_distances(frame(spark, cand, 1), frame(spark, ref, 1).withColumnRenamed("id", "rid"), "rid")
    best = {r.id: r.c for r in pairs.groupBy("id").agg(F.min("cos_dist").alias("c")).collect()}
    assert pairs.count() == 120 * 30
    assert best == pytest.approx({i: v[0] for i, v in brute(cand, ref, 1, np.min).items()})
    keyed = pair_distances(frame(spark, cand, 3), frame(spark, ref, 3).withColumnRenamed("id", "rid"), "rid", ["g"])
    assert keyed.count() == 3 * 40 * 10


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine_distance("a", "b").alias("c"), V.l2_distance("a", "b").alias("l")).first()
    assert (r.c, r.l) == (1.0, 1.0)


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, v array<double>")
    got = {r.k: r.m for r in df.groupBy("k").agg(V.mean_vector("v").alias("m")).collect()}
    assert got == {1: [2.0, 4.0], 2: [5.0, 5.0]}


@pytest.mark.parametrize("groups,k", [(1, 5), (1, 60), (3, 4)])
def test_most_distant(spark, data, groups, k):
    cand, ref = data
    got = most_distant(frame(spark, cand, groups), frame(spark, ref, groups), k, by=["g"])
    near = brute(cand, ref, groups, np.min)
    near = {i: (round(c, 9), round(l, 9)) for i, (c, l) in near.items()}
    for g in range(groups):
        mine = {i: v for i, v in near.items() if i % groups == g}
        avg = {i: ((1 + sum(o[0] > v[0] for o in mine.values())) + (1 + sum(o[1] > v[1] for o in mine.values()))) / 2
               for i, v in mine.items()}
        want = sorted(mine, key=lambda i: (avg[i], i))[:k]
        rows = sorted((r for r in got.collect() if r.g == f"g{g}"), key=lambda r: r.pos)
        assert [(r.id, r.avg_rank) for r in rows] == [(i, avg[i]) for i in want]


@pytest.mark.parametrize("reduction", ["min", "mean"])
def test_branches_agree_on_repeated_ids_and_nan(spark, data, reduction):
    nan = float("nan")
    cand = spark.createDataFrame([(1, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [nan, 1.0]), (None, [2.0, 2.0])], "id long, embedding array<double>")
    ref = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(6)] + [(9, [nan, 0.0])], "id long, embedding array<double>")
    got = []
    for options in ({}, {"max_broadcast_bytes": 0, "block_rows": 2}):
        out = nearest_distances(cand, ref, reduction=reduction, **options).collect()
        got.append(sorted((str(r.id), str(r.embedding), str(r.min_cos), str(r.min_l2)) for r in out))
    assert got[0] == got[1] and len(got[0]) == 4
    assert [x[3] == "None" for x in got[0]] == [False, False, True, False]  # NaN has no distance and can't rank
    if reduction == "min":
        assert [x[3] for x in got[0]] == ["1.0", "1.0", "None", "0.0"]


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 0, "block_rows": 3, "pivots": 4}])
@pytest.mark.parametrize("reduction", ["min", "mean"])
def test_vectors_without_a_distance(spark, options, reduction):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [1.0], [1.0, 2.0, 3.0], [nan, 1.0], [inf, 0.0], [1.0, None]]
    schema = "id long, embedding array<double>"
    cand = spark.createDataFrame([(0, [3.0, 4.0]), (100, [0.0, 0.0])] + [(k + 1, v) for k, v in enumerate(odd)], schema)
    ref = spark.createDataFrame([(0, [0.0, 4.0]), (1, [3.0, 0.0]), (2, [6.0, 8.0])] + [(k + 9, v) for k, v in enumerate(odd)], schema)
    got = {r.id: (r.min_cos, r.min_l2) for r in nearest_distances(cand, ref, reduction=reduction, **options).collect()}
    assert all(got[k + 1] == (None, None) for k in range(len(odd))) and len(got) == 2 + len(odd)
    want = {"min": ((0.0, 3.0), (1.0, 3.0)), "mean": (((0.2 + 0.4 + 0.0) / 3, (3 + 4 + 5) / 3), (1.0, (4 + 3 + 10) / 3))}[reduction]
    assert got[0] == pytest.approx(want[0], abs=1e-9) and got[100] == pytest.approx(want[1], abs=1e-9)
    empty = nearest_distances(cand, ref.where("id >= 9 AND id <> 12"), reduction=reduction, **options)
    assert empty.where("min_cos IS NOT NULL").count() in (0, 1)


def test_pruned_grid_skips_cells_and_agrees(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 5)) * 40
    cand, ref = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 5)) for n in (300, 400))
    ref[::50] = 0.0
    c, r = frame(spark, cand, 2), frame(spark, ref, 2)
    got = {}
    for name, options in (("all", {}), ("pruned", {"max_broadcast_bytes": 0, "block_rows": 60, "pivots": 12})):
        got[name] = {x.id: (x.min_cos, x.min_l2) for x in nearest_distances(c, r, by=["g"], **options).collect()}
    one, other = (np.array([v for _, v in sorted(got[n].items())]) for n in ("all", "pruned"))
    assert one.shape == (300, 2) and np.allclose(one, other, atol=1e-9)
    left, right = (df.select(F.col("g").alias("k"), F.col("id").alias(i), F.col("embedding").alias("v")) for df, i in ((c, "id"), (r, "rid")))
    rows, placed = D.needed_cells(left, right, False, 12)
    per_key = {x.k: x["count"] for x in placed.select("k", "cell").distinct().groupBy("k").count().collect()}
    asked = {x.k: x.n for x in rows.groupBy("k").agg(F.sum(F.size("cells")).alias("n")).collect()}
    assert all(asked[k] < 150 * n / 2 for k, n in per_key.items()), (asked, per_key)


def test_matrix_of_a_large_reference(spark, data):
    cand, ref = (frame(spark, m, 1) for m in data)
    pairs = [sorted(map(str, pair_distances(cand, ref.withColumnRenamed("id", "rid"), "rid", **o).drop("embedding").collect()))
             for o in ({}, {"max_broadcast_bytes": 700})]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 120 * 30


def test_rows_travel_once_for_each_part_not_for_each_block(spark):
    rng = np.random.default_rng(5)
    for n in (200, 800):  # far above any block of rows
        left, right = (frame(spark, rng.normal(size=(n, 4)), 2).select(F.col("g").alias("k"), F.col("id").alias(i), F.col("embedding").alias("v"))
                       for i in ("id", "rid"))
        assert D._dealt(left, right, ["k"]).count() == 2 * n
        assert D._compare(left, right, ["k"], "min", 8).count() == n


@pytest.mark.parametrize("reduction", ["min", "mean"])
def test_cells_of_many_parts(spark, data, reduction, monkeypatch):
    cand, ref = data
    for name, value in (("HELD_BYTES", 300), ("PART_PAIRS", 40), ("CELL_COPIES", 3)):
        monkeypatch.setattr(D, name, value)
    left, right = (frame(spark, m, 1).select(F.col("g").alias("k"), F.col("id").alias(i), F.col("embedding").alias("v"))
                   for m, i in ((cand, "id"), (ref, "rid")))
    dealt = D._dealt(left, right, ["k"])
    assert dealt.select("cb", "rb").distinct().count() == 3 * 5  # 30 rows of 48 bytes in parts of 300
    assert dealt.where("side = 0").count() == 3 * len(ref) and dealt.where("side = 1").count() == 5 * len(cand)
    got = nearest_distances(frame(spark, cand, 1), frame(spark, ref, 1), reduction=reduction, max_broadcast_bytes=0, block_rows=7).collect()
    want = brute(cand, ref, 1, np.min if reduction == "min" else np.mean)
    assert len(got) == len(cand)
    for r in got:
        assert (r.min_cos, r.min_l2) == pytest.approx(want[r.id], abs=1e-9)
