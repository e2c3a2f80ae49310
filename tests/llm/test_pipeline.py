"""The stages against plain Python, and on edge cases."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seqflow.llm import importance
from seqflow.llm.rows import with_row_key
from test_operators import brute_components, brute_hits, grams, lower


def test_stages_one_after_another(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").collect()]
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, smoke_dir)
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "exact dedup":
            assert ids == sorted({lower(t): i for i, t in sorted(before)}.values())
        elif name == "n-gram Jaccard join":
            assert ids == sorted({c for _, c in brute_components(before).values()})
        elif name == "benchmark decontamination":
            clean = [i for i, t in before for n, hit, _ in [brute_hits(t, items, 13)] if not (hit and 20 * hit >= n)]
            assert ids == sorted(clean)
        elif name == "encoding and decoding":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {r.doc_id: r.ids for r in after.collect()} == {
                i: t.encode(x, add_special_tokens=False).ids for i, x in before}
            break
        assert after.columns == docs.columns
        docs = after


def test_stages_on_edges(spark, smoke_dir, edge, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, smoke_dir)
        assert out.columns == edge.columns and 0 < out.count() <= edge.count()
        assert stage(spark, none, smoke_dir).count() == 0


def test_rows_of_one_id_are_decided_one_by_one(spark, smoke_dir):
    texts = [" ".join(f"{w}{k}" for w in "red fox ran over some old stone wall by night".split()) for k in "abcdefg"]
    near = " ".join([*texts[5].split() * 2, "tail"])
    docs = spark.createDataFrame([(None, t) for t in texts[:3]] + [
        (7, texts[3]), (7, texts[4]), (7, texts[3].upper()), (8, texts[3]),  # 7 loses one text, not the other
        (4, " ".join(texts[5].split() * 2)), (9, near), (9, texts[6])], "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.dedup_stage(spark, docs, smoke_dir)
    left = sorted(((r.doc_id or 0, r.text) for r in exact.collect()))
    assert left == sorted([(0, t) for t in texts[:3]] + [(7, texts[4]), (8, texts[3]), (9, texts[6]), (9, near),
                                                        (4, " ".join(texts[5].split() * 2))])
    near_left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_copy_stage(spark, exact, smoke_dir).collect())
    assert near_left == [r for r in left if r != (9, near)]
    bad = spark.read.parquet(f"{smoke_dir}/benchmark.parquet").where("length(text) > 100").first().text
    mixed = docs.unionByName(spark.createDataFrame([(7, bad), (None, bad)], docs.schema))
    clean = corpus_pipeline.benchmark_stage(spark, mixed, smoke_dir)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((r.doc_id or 0, r.text) for r in docs.collect())


def test_null_ids_are_sampled_one_by_one(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    labels = spark.read.parquet(f"{smoke_dir}/labels.parquet")
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").select("text").distinct().limit(8)
    mixed = docs.unionByName(bad.selectExpr("NULL AS doc_id", "text", "'en' AS lang", "'x' AS source", "1 AS n_chars").select(
        *[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    rows, key = with_row_key(mixed)
    scored = {r.row: r.sampled for r in importance.resample(rows, labels, row_col=key).collect()}
    want = Counter((r.doc_id, r.text) for r in rows.collect() if scored[r[key]])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, mixed, smoke_dir).collect())
    assert got == want and len(scored) == mixed.count()


def test_near_copies_of_five_words_at_80_percent(spark, smoke_dir):
    rng = random.Random(4)
    docs = []
    for n in (40, 90, 150):
        for _ in range(6):
            base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
            docs.append(base)
            for cut in (n // 20, n // 10, n // 6, n // 4):  # an added stretch of words
                at = rng.randrange(n)
                docs.append(base[:at] + [f"w{rng.randrange(10 ** 6)}" for _ in range(cut)] + base[at:])
    table = [(i, " ".join(d)) for i, d in enumerate(docs)]

    def firsts(words, percent):
        sets = [grams(t, words) for _, t in table]
        root = list(range(len(sets)))
        for x in range(len(sets)):
            for y in range(x):
                if root[x] != root[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                    a, b = sorted((root[x], root[y]))
                    root = [a if r == b else r for r in root]
        return sorted(set(root))
    out = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(5), smoke_dir)
    assert sorted(r.doc_id for r in out.collect()) == firsts(5, 80) != firsts(4, 85)
