"""Cleaning, encoding, tokens and statistics on small cases."""

import statistics

import pytest
from pyspark.sql import functions as F

from seqflow.functions import sequences as S
from seqflow.operators import stats


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("acdef", "ACDEF"), ("ACX-DE", "ACDE"), ("123", ""), ("Straße", "STRASSE")])
def test_clean(spark, text, want):
    assert one(spark, S.clean("s"), text) == want


@pytest.mark.parametrize("text,length,ids", [
    ("ACDEFGHIKL", 5, [0, 1, 2, 3, 4]), ("AC", 5, [0, 1, 0, 0, 0]), ("acdef", 5, [0, 1, 2, 3, 4]), ("ACX-DE", 4, [0, 1, 2, 3])])
def test_encode_fixed(spark, text, length, ids):
    assert one(spark, S.encode(S.fixed_length(S.clean("s"), length)), text) == ids


def test_encode_decode_round_trip(spark):
    assert one(spark, S.decode(S.encode("s")), S.ALPHABET) == S.ALPHABET


def test_invalid(spark):
    df = spark.createDataFrame([("ACD",), ("ACX",), ("ac",)], "seq string")
    assert [r.seq for r in stats.drop_invalid(df).collect()] == ["ACD"]


@pytest.mark.parametrize("n,tokens", [(0, 2), (5, 7), (1022, 1024), (1023, 1024), (5000, 1024)])
def test_tokens(spark, n, tokens):
    s = "A" * n
    assert one(spark, S.n_tokens("s"), s) == tokens
    ids = one(spark, S.tokenize("s"), s)
    assert (len(ids), ids[0], ids[-1]) == (tokens, S.START_ID, S.END_ID)
    assert one(spark, S.strip_special(S.tokenize("s")), s) == ids[1:]
    assert one(spark, S.strip_special(S.tokenize("s"), both=True), s) == ids[1:-1]


def test_kmers_and_composition(spark):
    assert one(spark, S.kmers("s", 3), "AAAACA") == ["AAA", "AAC", "ACA"]
    assert one(spark, S.kmers("s", 3), "AA") == []
    v = one(spark, S.composition("s"), "AACD")
    assert v[:3] == [0.5, 0.25, 0.25] and sum(v) == 1.0


def test_substitutions(spark):
    df = spark.createDataFrame([("ACDE", "AFDEKK"), ("AC", "AC")], "a string, b string")
    assert [r.x for r in df.select(S.substitutions("a", "b").alias("x")).collect()] == [1, 0]


def test_oversize_and_median(spark):
    df = spark.createDataFrame([("A" * n,) for n in (4, 5, 6, 9)], "seq string")
    assert stats.drop_oversize(df, 6).count() == 3
    assert stats.median_length(df).first().median == 5
    cut = stats.truncate_to(df, stats.median_length(df).scalar())
    assert [len(r.seq) for r in cut.collect()] == [4, 5, 5, 5]


def test_length_stats(spark):
    lens = [3, 3, 3, 8, 2, 10, 7]
    df = spark.createDataFrame([("g", "A" * n) for n in lens] + [("h", "A")], "g string, seq string")
    r = stats.length_stats(df, ["g"]).where("g = 'g'").first()
    half, run, n50 = sum(lens) / 2, 0, None
    for n in sorted(lens, reverse=True):
        run += n
        if n50 is None and run >= half:
            n50 = n
    assert (r.num_seqs, r.sum_len, r.min_len, r.max_len, r.n50) == (7, 36, 2, 10, n50)
    assert r.q2 == statistics.median(lens)


def test_hash_is_stable(spark):
    assert one(spark, S.hash32(42, F.col("s")), "x") == one(spark, S.hash32(42, "x"), "y")
