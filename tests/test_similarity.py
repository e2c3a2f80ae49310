"""Word search, scores and lists against sets in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflow.functions.sequences import ALPHABET
from seqflow.operators import similarity as M
from seqflow.operators.wordscan import Lookup, SmallSet

K = 3


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice(ALPHABET[:5]) for _ in range(n))
    targets = {f"t{i}": "AAAC" + word(30) for i in range(12)}
    targets["t90"] = targets["t91"] = targets["t0"]  # copies
    targets["t92"] = "AC"
    queries = {i: word(25) for i in range(30)}
    queries.update({100 + i: "AAACAAAC" for i in range(20)})  # copies of one hot text
    queries[200] = "AA"
    return targets, queries


def words(s):
    return {s[i:i + K] for i in range(len(s) - K + 1)}


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("store", [False, True])
def test_search_is_complete(spark, sets, few, store):
    targets, queries = sets
    index = M.build_index(spark.createDataFrame(list(targets.items()), "id string, seq string"), k=K, store=store)
    hits = M.search(spark.createDataFrame(list(queries.items()), "id long, seq string"), index, few_queries=few).collect()
    want = {(q, t): len(words(a) & words(b)) for q, a in queries.items() for t, b in targets.items()
            if words(a) & words(b)}
    assert {(r["query"], r.target): r.shared for r in hits} == want
    for r in hits:
        assert r.fident == pytest.approx(r.shared / len(words(queries[r["query"]])))


def test_search_within_groups(spark):
    t = spark.createDataFrame([("a", "t", "ACDEF"), ("b", "t", "ACDEF"), ("b", "u", "ACDXX")], "g string, id string, seq string")
    q = spark.createDataFrame([("a", "q", "ACDEF"), ("b", "q", "ACD")], "g string, id string, seq string")
    hits = M.search(q, M.build_index(t, k=K, by=["g"]))
    assert {(r.g, r.target, r.shared) for r in hits.collect()} == {("a", "t", 3), ("b", "t", 1), ("b", "u", 1)}


def test_scores(spark):
    hits = spark.createDataFrame([("q1", "t", 2.0), ("q1", "u", 4.0), ("q2", "t", 3.0)], "query string, target string, bits double")
    cand = spark.createDataFrame([("q1", "AC"), ("q2", "AD"), ("q3", "AE")], "id string, seq string")
    scored = M.attach_scores(cand, M.mean_scores(hits, "bits"))
    assert {r.id: r.reward for r in scored.collect()} == {"q1": 3.0, "q2": 3.0, "q3": 0.0}
    assert dict(scored.dtypes)["reward"] == "float"
    assert [r.id for r in M.best_average_scores(hits, cand, "bits").collect()] == ["q1", "q2"]
    s = M.score_stats(hits, "bits").first()
    assert (s["min"], s["max"], s["mean"]) == (2.0, 4.0, 3.0)
    assert M.keep_listed(cand, cand.where("id > 'q1'")).count() == 2


def test_scores_of_owners_are_summed_ahead_of_the_join(spark):
    rng = random.Random(8)
    hits = [(q, f"t{t}", rng.choice([None, rng.randrange(50)])) for q in range(30) for t in range(rng.randrange(1, 9))]
    owners = [(q, lang) for q in range(3, 35) for lang in (["x", "y"] if q % 9 == 0 else ["xyz"[q % 3]])] + [(40, None)]
    df = spark.createDataFrame(hits, "query long, target string, shared long")
    got = M.score_stats(df, "shared", ["lang"], spark.createDataFrame(owners, "query long, lang string"))
    want = {}
    for q, lang in owners:
        for score in (s for h, _, s in hits if h == q and s is not None):
            want.setdefault(lang, []).append(score)
    assert {r.lang: (r["min"], r["max"], r["mean"]) for r in got.collect()} == {
        k: (min(v), max(v), sum(v) / len(v)) for k, v in want.items()}
    blank = M.score_stats(df.where("shared IS NULL"), "shared", ["lang"], spark.createDataFrame(owners, "query long, lang string"))
    assert all((r["min"], r["max"], r["mean"]) == (None, None, None) for r in blank.collect())


def test_round_records(spark):
    seqs = spark.createDataFrame([("a", "ACDE"), ("b", "ACFEGG")], "id string, seq string")
    dist = spark.createDataFrame([("a", 0.1, 0.2)], "id string, min_cos double, min_l2 double")
    hits = spark.createDataFrame([("a", "t", 5.0)], "query string, target string, bits double")
    rec = {r.id: r for r in M.round_records(seqs, dist, hits, F.lit("ACDF"), "bits", 2).collect()}
    assert (rec["a"].round, rec["a"].length, rec["a"].mean_score, rec["a"].substitutions) == (2, 4, 5.0, 1)
    assert (rec["b"].mean_score, rec["b"].min_l2, rec["b"].substitutions) == (None, None, 2)


def test_texts_of_round_records_travel_only_if_kept(spark):
    seqs = spark.createDataFrame([("a", "ACDE")], "id string, seq string")
    dist = spark.createDataFrame([("a", 0.1, 0.2)], "id string, min_cos double, min_l2 double")
    hits = spark.createDataFrame([("a", "t", 5.0)], "query string, target string, bits double")
    rec = M.round_records(seqs, dist, hits, F.lit("ACDF"), "bits", 2).drop("seq")
    plan = rec._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("length(seq")


@pytest.mark.parametrize("shares", [(0.2,), (0.9, 0.5, 0.2), (1.0, 0.2)])
@pytest.mark.parametrize("n", [1, 3, 100])
def test_top_hits_equal_brute_force(spark, shares, n):
    rng = random.Random(4)
    base = ["".join(rng.choice("ACDE") for _ in range(60)) for _ in range(6)]
    cut = lambda s: s[rng.randrange(20):][:rng.randrange(10, 60)]
    targets = [(i, cut(rng.choice(base)) + cut(rng.choice(base))) for i in range(60)] + [(60, ""), (61, base[0])]
    queries = [(i, cut(rng.choice(base))) for i in range(15)] + [(15, ""), (16, "WWWWWWWW"), (17, base[0])]
    words = lambda s: {s[i:i + 4] for i in range(len(s) - 3)}
    want = set()
    for q, s in queries:
        w = words(s)
        hits = sorted((-len(w & words(t)), i) for i, t in targets if w and len(w & words(t)) >= math.ceil(len(w) * shares[-1]))
        want |= {(q, i, -k, pos + 1) for pos, (k, i) in enumerate(hits[:n])}
    schema = "id long, seq string"
    index = M.build_index(spark.createDataFrame(targets, schema), k=4, store=True)
    got = M.top_hits(spark.createDataFrame(queries, schema), index, n, shares)
    assert {(r["query"], r.target, r.shared, r.pos) for r in got.collect()} == want


ODD = ["ACDEACDE", "ACD?ACD", "AC\nDEACD", "\u00e9ACDE", "ACDE\U0001f600ACDE", "", None, "AC", "ACDEFACDEF"]


@pytest.mark.parametrize("odd", [False, True])
def test_paths_agree_on_odd_rows(spark, monkeypatch, odd):
    """Null, empty and foreign texts, null groups, ids of several rows on both sides: as the join of all words has it."""
    texts = ODD if odd else [t for t in ODD if t is None or t.isascii() and "?" not in t]
    rows = [(g, i % 5 if i else None, t) for g in ("a", "b", None) for i, t in enumerate(texts)]
    t = spark.createDataFrame(rows + [("a", 50, "ACDEACDE"), ("c", 1, "ACDEF")], "g string, id long, seq string")
    q = spark.createDataFrame(rows[::-1] + [("a", 60, "CDEACD"), ("d", 1, "ACDEF")], "g string, id long, seq string")

    def rows_of(few):
        return sorted(map(tuple, M.search(q, M.build_index(t, k=K, by=["g"]), few_queries=few).collect()), key=repr)

    few, many = rows_of(True), rows_of(False)
    assert few and few == many
    monkeypatch.setattr(M, "BROADCAST_WORDS", -1)
    assert rows_of(True) == few


def test_words_of_the_large_side_are_never_rows(spark, sets):
    targets, queries = (spark.createDataFrame(list(s.items()), f"id {t}, seq string") for s, t in zip(sets, ("string", "long")))
    index = M.build_index(targets, k=K, store=True)
    for few in (True, False):
        plan = M.search(queries, index, few_queries=few)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan


def test_shared_words_with_and_without_a_table():
    starts, texts = np.array([0, 2, 3, 5]), np.array([0, 2, 1, 0, 1])
    grid = np.array([[1, 0, 1], [0, 1, 0], [1, 1, 0]], np.uint8)
    for g in (None, grid):
        for n, words in ((3, [0]), (3, [0, 2]), (3, [0, 1, 2])) + (((5000, [0, 2]),) if g is None else ()):
            hit, count = SmallSet(None, starts, texts, n, g).count(np.array(words))
            assert dict(zip(hit.tolist(), count.tolist())) == {t: int(k) for t, k in enumerate(grid[words].sum(0)) if k}


def test_lookup_finds_codes_that_share_a_slot():
    rng = np.random.default_rng(3)
    listed = np.unique(rng.integers(0, 1 << 31, 20_000))
    asked = np.concatenate([listed, rng.integers(0, 1 << 31, 20_000)])
    lookup = Lookup(listed)
    assert len(lookup.lost)
    found, at = lookup.find(asked)
    assert found.tolist() == np.flatnonzero(np.isin(asked, listed)).tolist()
    assert (listed[at] == asked[found]).all()
