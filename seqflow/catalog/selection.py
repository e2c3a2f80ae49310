"""Embedding distance, ranking and selection over ``embeddings``.

The reference set is the mean vector of each label, so every stored vector
takes part on both sides and the reference grows with labels, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqflow.catalog.registry import query, table
from seqflow.functions.vectors import mean_vector, norm
from seqflow.operators.distance import nearest_distances, pair_distances
from seqflow.operators.ranking import average_ranks, distance_stats, most_distant
from seqflow.operators.rounds import previous_round_reference
from seqflow.session import materialize
from seqflow.sources.reports import read_evaluations, write_evaluations

TOP_K = 10


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def label_means(emb: DataFrame) -> DataFrame:
    """One reference row per label; small, so it is computed once and stored."""
    means = emb.groupBy("label").agg(mean_vector("embedding").alias("embedding"))
    return materialize(means, "label-means")


CENTROIDS = """
cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p
  FROM embeddings),
means AS (
  SELECT label AS ref_label, list(m ORDER BY p) AS rv
  FROM (SELECT label, p, avg(v) AS m FROM cells GROUP BY label, p) GROUP BY label),
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

NEAREST = CENTROIDS + """,
near AS (
  SELECT vec_id, label, round(min(list_cosine_distance(v, rv)), 12) AS c, round(min(list_distance(v, rv)), 12) AS l
  FROM vecs CROSS JOIN means GROUP BY vec_id, label)"""


@query("most_distant", f"""WITH {NEAREST},
ranked AS (
  SELECT *, (rank() OVER (ORDER BY c DESC) + rank() OVER (ORDER BY l DESC)) / 2.0 AS avg_rank FROM near),
placed AS (SELECT *, row_number() OVER (ORDER BY avg_rank, vec_id) AS pos FROM ranked)
SELECT vec_id, pos::INTEGER AS pos, avg_rank, round(c, 6) AS min_cos, round(l, 6) AS min_l2
FROM placed WHERE pos <= {TOP_K}""")
def most_distant_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    top = most_distant(emb, label_means(emb), TOP_K, "vec_id")
    return top.select("vec_id", "pos", "avg_rank", r6("min_cos", "min_cos"), r6("min_l2", "min_l2"))


@query("most_distant_nulls", f"""WITH {NEAREST},
seen AS (SELECT *, vec_id % 5 > 3 OR vec_id % 7 = 6 OR vec_id % 11 = 10 OR vec_id % 13 = 12 AS bad FROM near),
ranked AS (SELECT vec_id, c, l, (rank() OVER (ORDER BY c DESC) + rank() OVER (ORDER BY l DESC)) / 2.0 AS avg_rank FROM seen WHERE NOT bad)
SELECT vec_id, bad, CASE WHEN NOT bad THEN round(seen.c, 6) END AS min_cos, CASE WHEN NOT bad THEN round(seen.l, 6) END AS min_l2,
  avg_rank FROM seen LEFT JOIN ranked USING (vec_id)""")
def most_distant_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some vectors are null, too short, NaN or infinite: they have no distance and no rank."""
    emb = table(spark, sf_dir, "embeddings")
    v, i = F.col("embedding").cast("array<double>"), F.col("vec_id")
    odd = (F.when(i % 5 > 3, F.lit(None)).when(i % 7 == 6, F.slice(v, 1, 10))
           .when(i % 11 == 10, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 1000)))
           .when(i % 13 == 12, F.concat(F.array(F.lit(float("-inf"))), F.slice(v, 2, 1000))).otherwise(v))
    bad = (i % 5 > 3) | (i % 7 == 6) | (i % 11 == 10) | (i % 13 == 12)
    rows = emb.select("vec_id", odd.alias("embedding"), bad.alias("bad"))
    dist = materialize(nearest_distances(rows, label_means(emb), "vec_id").drop("embedding"), "distances")
    ranks = average_ranks(dist.where("min_cos IS NOT NULL"))
    return dist.join(ranks, ["min_cos", "min_l2"], "left").select(
        "vec_id", "bad", r6("min_cos", "min_cos"), r6("min_l2", "min_l2"), "avg_rank")


@query("nearest_pruned", f"""WITH vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, round(min(list_cosine_distance(a.v, b.v)), 6) AS min_cos, round(min(list_distance(a.v, b.v)), 6) AS min_l2
FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id % 2 <> b.vec_id % 2 GROUP BY a.vec_id""")
def nearest_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of the same label and the other parity, by pivot cells, none of them broadcast."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 2).alias("side"))
    other = emb.withColumn("side", 1 - F.col("side"))
    out = nearest_distances(emb, other, "vec_id", by=["label", "side"], max_broadcast_bytes=0, block_rows=64, pivots=16)
    return out.where("min_l2 IS NOT NULL").select("vec_id", r6("min_cos", "min_cos"), r6("min_l2", "min_l2"))


@query("pairwise_distance", f"""WITH {CENTROIDS}
SELECT vec_id, ref_label AS ref_id, round(list_cosine_distance(v, rv), 6) AS cos_dist,
       round(list_distance(v, rv), 6) AS l2_dist
FROM vecs CROSS JOIN means""")
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    pairs = pair_distances(emb.select("vec_id", "embedding"), label_means(emb), "label")
    return pairs.select("vec_id", "ref_id", r6("cos_dist", "cos_dist"), r6("l2_dist", "l2_dist"))


@query("mean_pool", f"""WITH {CENTROIDS}
SELECT ref_label AS label, i::INTEGER AS dim, round(rv[i + 1], 6) AS mean
FROM means, range(64) t(i)""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = label_means(table(spark, sf_dir, "embeddings"))
    return (means.select("label", F.posexplode("embedding").alias("dim", "mean"))
            .select("label", "dim", r6("mean", "mean")))


STATS_SQL = """min(c) AS cosine_min, max(c) AS cosine_max, avg(c) AS cosine_mean,
       min(l) AS l2_min, max(l) AS l2_max, avg(l) AS l2_mean"""
STAT_NAMES = ("cosine_min", "cosine_max", "cosine_mean", "l2_min", "l2_max", "l2_mean")


def _label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return distance_stats(nearest_distances(emb, label_means(emb), "vec_id"), ["label"])


@query("embedding_stats", f"""WITH {NEAREST}, s AS (SELECT label, {STATS_SQL} FROM near GROUP BY label)
SELECT label, {", ".join(f"round({n}, 6) AS {n}" for n in STAT_NAMES)} FROM s""")
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_stats(spark, sf_dir).select("label", *[r6(n, n) for n in STAT_NAMES])


@query("eval_json", f"""WITH {NEAREST}, s AS (SELECT label, {STATS_SQL} FROM near GROUP BY label)
SELECT label AS target, 1 AS round, {", ".join(f"round({n}, 6) AS {n}" for n in STAT_NAMES)} FROM s""")
def eval_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the evaluation of every label as JSON, read it back, flatten it."""
    evals = _label_stats(spark, sf_dir).select(
        F.col("label").cast("string").alias("target"), F.lit(1).alias("round"),
        F.struct(*STAT_NAMES).alias("embedding"))
    back = read_evaluations(spark, write_evaluations(evals))
    return back.select(F.col("target").cast("int").alias("target"), "round",
                       *[r6(F.col(f"embedding.{n}"), n) for n in STAT_NAMES])


MULTI_K = 5


def _select_two_rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Round 1 against each label's mean, round 2 against the round-1 selection."""
    emb = table(spark, sf_dir, "embeddings")
    inputs = label_means(emb).select("label", (-F.col("label").cast("bigint") - 1).alias("vec_id"),
                                     "embedding")
    selected = None
    reference = previous_round_reference(inputs, None)
    for r in (1, 2):
        now = reference.where(F.col("round") == r)
        top = most_distant(emb, now, MULTI_K, "vec_id", by=["label"])
        rows = top.select("label", "vec_id", "pos", "avg_rank", "min_cos", "min_l2",
                          F.lit(r).alias("round"))
        rows = materialize(rows.join(emb.select("vec_id", "embedding"), "vec_id"), "selected")
        selected = rows if selected is None else selected.unionByName(rows)
        reference = previous_round_reference(inputs, selected)
    return selected, reference


def _round_sql(n: int) -> str:
    refs = ("SELECT ref_label AS label, rv FROM means" if n == 1 else
            f"SELECT label, v AS rv FROM vecs JOIN sel{n - 1} USING (vec_id, label)")
    return f"""
near{n} AS (
  SELECT vec_id, vecs.label, round(min(list_cosine_distance(v, rv)), 12) AS c, round(min(list_distance(v, rv)), 12) AS l
  FROM vecs JOIN ({refs}) r ON r.label = vecs.label GROUP BY vec_id, vecs.label),
rank{n} AS (
  SELECT *, (rank() OVER (PARTITION BY label ORDER BY c DESC)
           + rank() OVER (PARTITION BY label ORDER BY l DESC)) / 2.0 AS avg_rank FROM near{n}),
sel{n} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY avg_rank, vec_id) AS pos
                 FROM rank{n}) WHERE pos <= {MULTI_K})"""


TWO_ROUNDS = f"{CENTROIDS},{_round_sql(1)},{_round_sql(2)}"


@query("multi_target", f"""WITH {TWO_ROUNDS},
both_rounds AS (SELECT 1 AS round, * FROM sel1 UNION ALL SELECT 2, * FROM sel2)
SELECT label, round, vec_id, pos::INTEGER AS pos, avg_rank, round(c, 6) AS min_cos, round(l, 6) AS min_l2
FROM both_rounds""")
def multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _ = _select_two_rounds(spark, sf_dir)
    return selected.select("label", "round", "vec_id", "pos", "avg_rank",
                           r6("min_cos", "min_cos"), r6("min_l2", "min_l2"))


@query("prev_round_ref", f"""WITH {TWO_ROUNDS},
refs AS (
  SELECT 1 AS round, ref_label AS label, -ref_label::BIGINT - 1 AS ref_id, rv FROM means
  UNION ALL SELECT 2, label, vec_id, v FROM sel1 JOIN vecs USING (vec_id, label)
  UNION ALL SELECT 3, label, vec_id, v FROM sel2 JOIN vecs USING (vec_id, label))
SELECT round, label, ref_id, round(sqrt(list_sum(list_transform(rv, lambda x: x * x))), 6) AS norm FROM refs""")
def prev_round_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reference = _select_two_rounds(spark, sf_dir)
    return reference.select("round", "label", F.col("vec_id").alias("ref_id"),
                            r6(norm("embedding"), "norm"))
