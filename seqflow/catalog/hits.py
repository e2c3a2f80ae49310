"""Scores, selections and populations over ``documents``, ``benchmark``, ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seqflow.catalog.batches import BENCH, bench_seqs
from seqflow.catalog.registry import query, table
from seqflow.catalog.selection import r6
from seqflow.catalog.sequences import COMP_SQL, SEQS, seqs
from seqflow.functions import sequences as S
from seqflow.operators import population as P, similarity as M
from seqflow.operators.distance import nearest_distances

K = 7


def words_sql(name: str, source: str, id_col: str, k: int = K) -> str:
    return f"""{name} AS (SELECT DISTINCT {id_col}, word FROM (
  SELECT {id_col}, unnest(list_transform(range(1, length(seq) - {k - 2}), lambda i: substr(seq, i, {k}))) AS word
  FROM {source} WHERE length(seq) >= {k}))"""


HITS = f"""{SEQS}, {BENCH},
{words_sql("qw", "seqs", "doc_id")},
{words_sql("tw", "bench", "item_id")},
qn AS (SELECT doc_id, count(*) AS n FROM qw GROUP BY doc_id),
hits AS (
  SELECT doc_id AS query, item_id AS target, count(*) AS shared, count(*) / any_value(n) AS fident
  FROM qw JOIN tw USING (word) JOIN qn USING (doc_id) GROUP BY doc_id, item_id)"""


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = M.build_index(bench_seqs(spark, sf_dir), "item_id", k=K)
    return M.search(seqs(spark, sf_dir), index, "doc_id")


@query("kmer_search", f"WITH {HITS} SELECT query, target, shared, round(fident, 6) AS fident FROM hits")
def kmer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_hits(spark, sf_dir).withColumn("fident", r6("fident"))


TOP_HITS, LEAST_SHARE = 3, 0.25


@query("kmer_top_hits", f"""WITH {SEQS}, {BENCH},
{words_sql("dw", "seqs", "doc_id")},
{words_sql("bw", "bench", "item_id")},
bn AS (SELECT item_id, count(*) AS n FROM bw GROUP BY item_id),
h AS (SELECT item_id AS query, doc_id AS target, count(*) AS shared, any_value(n) AS n FROM bw JOIN dw USING (word) JOIN bn USING (item_id) GROUP BY ALL)
SELECT query, target, shared, round(shared / n, 6) AS fident, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, target) AS pos FROM h WHERE shared >= ceil(n * {LEAST_SHARE}::DOUBLE)) WHERE pos <= {TOP_HITS}""")
def kmer_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most words with each benchmark item."""
    index = M.build_index(seqs(spark, sf_dir), "doc_id", k=K)
    top = M.top_hits(bench_seqs(spark, sf_dir), index, TOP_HITS, (0.8, 0.5, LEAST_SHARE), "item_id")
    return top.withColumn("fident", r6("fident"))


@query("avg_score", f"WITH {HITS} SELECT query, round(avg(fident), 6) AS avg_score FROM hits GROUP BY query")
def avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_scores(search_hits(spark, sf_dir), "fident").withColumn("avg_score", r6("avg_score"))


@query("best_avg_score", f"""WITH {HITS}, a AS (SELECT query AS doc_id, avg(shared) AS avg_score FROM hits GROUP BY query)
SELECT doc_id, round(avg_score, 6) AS avg_score, length(seq)::INTEGER AS length
FROM a JOIN seqs USING (doc_id)""")
def best_avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seqs(spark, sf_dir)
    best = M.best_average_scores(search_hits(spark, sf_dir), docs, "shared", "doc_id")
    return best.select("doc_id", r6("avg_score", "avg_score"), F.length("seq").alias("length"))


@query("structure_stats", f"""WITH {HITS}
SELECT lang AS target, min(shared) AS min, max(shared) AS max, round(avg(shared), 6) AS mean
FROM hits JOIN documents ON doc_id = query GROUP BY lang""")
def structure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), F.col("lang"))
    s = M.score_stats(search_hits(spark, sf_dir), "shared", ["lang"], docs).withColumnRenamed("lang", "target")
    return s.withColumn("mean", r6("mean"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as hits: two scores per labelled document."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("query"),
                      F.explode(F.array(F.col("quality"), 1 - F.col("toxic"))).alias("score"))


SCORED = f"""{SEQS},
lab AS (SELECT doc_id, avg(s) AS a FROM (
  SELECT doc_id, unnest([quality, 1 - toxic]) AS s FROM labels) GROUP BY doc_id),
scored AS (SELECT doc_id, source, seq, coalesce(a, 0.0)::FLOAT AS reward FROM seqs LEFT JOIN lab USING (doc_id))"""


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = M.mean_scores(label_scores(spark, sf_dir), "score")
    return M.attach_scores(seqs(spark, sf_dir, keep_empty=True).select("doc_id", "source", "seq"), scores, "doc_id")


@query("score_attach", f"WITH {SCORED} SELECT doc_id, reward FROM scored")
def score_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_docs(spark, sf_dir).select("doc_id", "reward")


@query("select_by_list", f"""WITH {SEQS} SELECT doc_id, seq FROM seqs
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def select_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return M.keep_listed(seqs(spark, sf_dir, keep_empty=True).select("doc_id", "seq"), good, "doc_id")


POPULATION = f"""{SCORED},
pop AS (SELECT source, seq, 0.0::FLOAT AS reward, 0 AS batch_index FROM scored
        UNION ALL SELECT source, seq, reward, 1 FROM scored)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_docs(spark, sf_dir).select("source", "seq", "reward")
    start = scored.withColumn("reward", F.lit(0.0).cast("float")).withColumn("batch_index", F.lit(0))
    return P.append_batch(start, scored, 1)


@query("population_append", f"""WITH {POPULATION}
SELECT source, batch_index, count(*) AS n, sum(reward)::DOUBLE AS reward, sum(length(seq))::BIGINT AS residues
FROM pop GROUP BY source, batch_index""")
def population_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population(spark, sf_dir).groupBy("source", "batch_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("double")).alias("reward"),
        F.sum(F.length("seq")).cast("bigint").alias("residues"))


@query("batch_rewards", f"""WITH {POPULATION}
SELECT source, 1 AS batch_index, max(reward) AS best_reward, round(avg(reward), 6) AS mean_reward,
       any_value(t.n) AS population, 2 AS next_batch
FROM pop JOIN (SELECT source, count(*) AS n FROM pop GROUP BY source) t USING (source)
WHERE batch_index = 1 GROUP BY source""")
def batch_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = P.batch_report(population(spark, sf_dir), ["source"])
    return rep.withColumn("mean_reward", r6("mean_reward")).withColumn(
        "next_batch", F.col("batch_index") + 1)


@query("best_n", f"""WITH {POPULATION}, d AS (SELECT source, seq, max(reward) AS reward FROM pop GROUP BY source, seq)
SELECT source, md5(seq) AS seq_md5, reward, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY reward DESC, seq) AS pos FROM d) WHERE pos <= 8""")
def best_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = P.best_n(population(spark, sf_dir), 8, ["source"])
    return best.select("source", F.md5("seq").alias("seq_md5"), "reward", "pos")


@query("fallback_set", f"""WITH {SCORED},
good AS (SELECT source, doc_id, reward FROM scored WHERE reward >= 0.99 AND length(seq) > 4000),
firsts AS (SELECT source, doc_id, reward FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM scored) WHERE rn <= 3)
SELECT source, doc_id, reward FROM good
UNION ALL SELECT source, doc_id, reward FROM firsts WHERE source NOT IN (SELECT source FROM good)""")
def fallback_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents with a full score; a source without any falls back to its first three."""
    scored = scored_docs(spark, sf_dir)
    good = scored.where((F.col("reward") >= 0.99) & (F.length("seq") > 4000))
    first = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    spare = scored.withColumn("_rn", first).where(F.col("_rn") <= 3)
    cols = ["source", "doc_id", "reward"]
    return P.with_fallback(good.select(*cols), spare.select(*cols), ["source"])


@query("seq_records", f"""WITH {HITS},
e AS (SELECT doc_id, [{COMP_SQL}] AS v FROM seqs WHERE length(seq) > 0),
r AS (SELECT [{COMP_SQL}] AS rv FROM bench),
near AS (SELECT doc_id, round(min(list_cosine_distance(v, rv)), 12) AS c, round(min(list_distance(v, rv)), 12) AS l
         FROM e CROSS JOIN r GROUP BY doc_id),
score AS (SELECT query AS doc_id, avg(shared) AS a FROM hits GROUP BY query),
wt AS (SELECT seq AS w FROM bench ORDER BY item_id LIMIT 1)
SELECT 1 AS round, doc_id, length(seq)::INTEGER AS length, round(a, 6) AS mean_score,
  round(c, 6) AS min_cos, round(l, 6) AS min_l2,
  len(list_filter(range(1, least(length(seq), length(w)) + 1),
      lambda i: substr(seq, i, 1) <> substr(w, i, 1)))::INTEGER AS substitutions
FROM seqs LEFT JOIN near USING (doc_id) LEFT JOIN score USING (doc_id), wt WHERE length(seq) > 0""")
def seq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seqs(spark, sf_dir).select("doc_id", "seq")
    bench = bench_seqs(spark, sf_dir)
    dist = nearest_distances(docs.select("doc_id", S.composition("seq").alias("embedding")),
                             bench.select(S.composition("seq").alias("embedding")), "doc_id")
    wild_type = bench.orderBy("item_id").limit(1).select("seq").scalar()
    rec = M.round_records(docs, dist, search_hits(spark, sf_dir), wild_type, "shared", 1, "doc_id")
    return rec.drop("seq").select("round", "doc_id", "length", r6("mean_score", "mean_score"),
                                  r6("min_cos", "min_cos"), r6("min_l2", "min_l2"), "substitutions")
