"""Chunked scans against plain Python, with one key owning most rows."""

import random

import pytest
from pyspark.sql import functions as F

from seqflow.operators import ordered as O

SMALL = {"chunk_rows": 40, "max_chunks": 16}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    ids = rng.sample(range(100_000), 900)
    return [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(10)) for i in ids]


def by_key(rows):
    out = {}
    for i, k, v in sorted(rows):
        out.setdefault(k, []).append((i, v))
    return out


def test_chunks_are_bounded_and_ordered(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, v long")
    cut = O.chunked(df, "id", **SMALL).groupBy(O.CHUNK).agg(
        F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy(O.CHUNK).collect()
    assert len(cut) > 10
    assert max(r.n for r in cut) <= 2 * 900 / len(cut)
    assert all(x.b < y.a for x, y in zip(cut, cut[1:]))


def test_ordinal_and_sums(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {r.id: (r.ord, r.seen) for r in O.ordinal(
        O.prefix_sums(df, "id", {"seen": F.col("v")}, ["k"], **SMALL), "id", ["k"], **SMALL).collect()}
    want = {}
    for items in by_key(rows).values():
        total = 0
        for n, (i, v) in enumerate(items):
            want[i] = (n, total)
            total += v
    assert got == want


def test_global_order(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {r.id: r.ord for r in O.ordinal(df, "id", **SMALL).collect()}
    assert got == {i: n for n, (i, _, _) in enumerate(sorted(rows))}


def test_previous_crosses_chunks(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, v long")
    got = {r.id: r.p for r in O.previous(df, "id", {"p": "v"}, ["k"], **SMALL).collect()}
    want = {}
    for items in by_key(rows).values():
        prev = None
        for i, v in items:
            want[i], prev = prev, v
    assert got == want


def test_null_key_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, k string")
    got = {r.id: r.ord for r in O.ordinal(df, "id", ["k"], chunk_rows=1, max_chunks=3).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("desc", [False, True])
def test_ranks_with_heavy_tie(spark, rows, desc):
    data = [(k, 7.5 if n % 3 == 0 else float(v) + i / 1e6) for n, (i, k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {(r.k, r.x): r["rank"] for r in O.value_ranks(df, "x", ["k"], descending=desc, **SMALL).collect()}
    for (k, x), r in got.items():
        assert r == 1 + sum(1 for kk, xx in data if kk == k and (xx > x if desc else xx < x))
    assert len(got) == len(set(data))


def test_null_and_nan_order_values_at_every_size(spark):
    values = [None, *map(float, range(200)), float("nan")]
    df = spark.createDataFrame([(v, k % 2, k) for k, v in enumerate(values)], "o double, k int, v long").repartition(5)
    one = O.previous(df, "o", {"p": "v"}, ["k"]).select("v", "p").collect()
    many = O.previous(df, "o", {"p": "v"}, ["k"], **SMALL).select("v", "p").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and {r.v: r.p for r in many}[201] == 199
    got = {r.v: r.ord for r in O.ordinal(df, "o", **SMALL).collect()}
    assert got == {k: k for k in range(len(values))}
    lone = spark.createDataFrame([(None, 7)] + [(float(k), k + 100) for k in range(60)], "o double, v long")
    cut = O.chunked(lone, "o", chunk_rows=20)
    assert cut.where("o IS NULL").first()[O.CHUNK] == 0 and cut.select(O.CHUNK).distinct().count() > 2
    nulls = spark.createDataFrame([(None, k) for k in range(90)], "o double, v long")
    assert O.chunked(nulls, "o", **SMALL).count() == 90


def test_one_scan_gives_sums_lags_and_firsts(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, v long")
    out = O.ordered_scan(df, "id", ["k"], sums={"seen": F.col("v")}, lags={"p": "v"}, firsts={"f": "v"}, chunk_rows=30)
    want = {}
    for items in by_key(rows).values():
        total, prev = 0, None
        for i, v in items:
            want[i] = (total, prev, items[0][1])
            total, prev = total + v, v
    assert {r.id: (r.seen, r.p, r.f) for r in out.collect()} == want
