"""Evolution search and the selection campaign over ``documents``; targets are languages."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.hits import K, words_sql
from seqflow.catalog.registry import query
from seqflow.catalog.selection import STAT_NAMES, r6
from seqflow.catalog.sequences import COMP_SQL, SEQS, seqs
from seqflow.functions.sequences import ALPHABET
from seqflow.operators import similarity as M
from seqflow.operators.embed import composition_model
from seqflow.operators.stats import length_stats
from seqflow.plans.campaign import Campaign, Settings, run_campaign
from seqflow.plans.evolve import OFFSETS, WEIGHT_UNITS, evolve, index_scorer, propose_weighted
from seqflow.session import materialize
from seqflow.sources.reports import read_round_records, write_round_records

STEPS, BATCH, BEST, MUTATIONS, SEED, TOP = 2, 40, 15, 2, 42, 5


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def step_sql(r: int, s: int, weighted: bool = False) -> str:
    """Step ``s`` of round ``r``: mutate parents, hashed or by weight, score them, append."""
    d = [str(SEED), str(r), str(s), "goal", "i"]
    if weighted:  # tooth i of the comb lies at (i * OFFSETS + h) / (BATCH * OFFSETS) of the total weight
        h = f"({draw_sql(str(SEED), str(r), str(s), 'goal', chr(39) + 'comb' + chr(39))} % {OFFSETS})"
        sql = f"""
sum{r}_{s} AS (SELECT goal, pos, sum(w) OVER (PARTITION BY goal ORDER BY pos) AS upto, w, sum(w) OVER (PARTITION BY goal) AS total
  FROM (SELECT goal, pos, round(reward::DOUBLE * {WEIGHT_UNITS})::BIGINT + 1 AS w FROM pop{r}_{s})),
slot{r}_{s} AS (SELECT goal, i, pos FROM sum{r}_{s}, range({BATCH}) q(i)
  WHERE (upto - w) * {BATCH * OFFSETS} <= (i * {OFFSETS} + {h}) * total AND (i * {OFFSETS} + {h}) * total < upto * {BATCH * OFFSETS}),"""
    else:
        sql = f"""
slot{r}_{s} AS (SELECT goal, i, {draw_sql(*d, "'parent'")} % (n + {s * BATCH}) AS pos
  FROM size{r}, range({BATCH}) q(i)),"""
    sql += f"""
cand{r}_{s}_0 AS (SELECT goal, i, seq FROM slot{r}_{s} JOIN pop{r}_{s} USING (goal, pos)),"""
    for j in range(MUTATIONS):
        p = f"({draw_sql(*d, str(j), chr(39) + 'pos' + chr(39))} % length(seq))"
        g = f"(1 + {draw_sql(*d, str(j), chr(39) + 'letter' + chr(39))} % {len(ALPHABET) - 1})"
        sql += f"""
mut{r}_{s}_{j} AS (SELECT goal, i, seq, {p} AS p, {g} AS g FROM cand{r}_{s}_{j}),
cand{r}_{s}_{j + 1} AS (SELECT goal, i, substr(seq, 1, p) || substr('{ALPHABET}',
    (strpos('{ALPHABET}', substr(seq, p + 1, 1)) - 1 + g) % {len(ALPHABET)} + 1, 1) || substr(seq, p + 2) AS seq
  FROM mut{r}_{s}_{j}),"""
    last = f"cand{r}_{s}_{MUTATIONS}"
    words = words_sql(f"cw{r}_{s}", last, "i").replace(
        "SELECT DISTINCT i, word", "SELECT DISTINCT goal, i, word").replace("SELECT i, unnest", "SELECT goal, i, unnest")
    return sql + f"""
{words},
sc{r}_{s} AS (SELECT goal, i, avg(shared) AS a FROM (
  SELECT goal, i, doc_id, count(*) AS shared FROM cw{r}_{s} JOIN iw USING (goal, word) GROUP BY ALL) GROUP BY goal, i),
pop{r}_{s + 1} AS (SELECT * FROM pop{r}_{s} UNION ALL
  SELECT goal, n + {s * BATCH} + i, seq, coalesce(a, 0.0)::FLOAT
  FROM {last} LEFT JOIN sc{r}_{s} USING (goal, i) JOIN size{r} USING (goal))"""


def evolve_sql(r: int, start: str, order: str, weighted: bool = False) -> str:
    return f"""
pop{r}_0 AS (SELECT goal, row_number() OVER (PARTITION BY goal ORDER BY {order}) - 1 AS pos,
    rpad(substr(seq, 1, len), len, 'A') AS seq, 0.0::FLOAT AS reward FROM {start} JOIN med USING (goal)),
size{r} AS (SELECT goal, count(*) AS n FROM pop{r}_0 GROUP BY goal),
{", ".join(step_sql(r, s, weighted) for s in range(STEPS))},
gen{r} AS (SELECT goal, 'gen_r{r}_' || (rn - 1) AS seq_id, seq, reward, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY goal ORDER BY reward DESC, seq) AS rn FROM (
    SELECT goal, seq, max(reward) AS reward FROM pop{r}_{STEPS} GROUP BY goal, seq)) WHERE rn <= {BEST})"""


INPUTS = f"""{SEQS}, inp AS (SELECT lang AS goal, doc_id, seq FROM seqs WHERE length(seq) > 0),
med AS (SELECT goal, floor(quantile_cont(length(seq), 0.5))::INTEGER AS len FROM inp GROUP BY goal),
{words_sql("iw0", "inp", "doc_id")},
iw AS (SELECT goal, doc_id, word FROM iw0 JOIN inp USING (doc_id))"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = seqs(spark, sf_dir)
    return docs.select(F.col("lang").alias("goal"), "doc_id",
                       F.concat(F.lit("doc_"), "doc_id").alias("seq_id"), "seq")


@query("evolve", f"""WITH {INPUTS}, {evolve_sql(1, "inp", "doc_id")}
SELECT goal, seq_id, md5(seq) AS seq_md5, round(reward::DOUBLE, 4) AS reward, rn::INTEGER AS pos FROM gen1""")
def evolve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolved(spark, sf_dir)


def evolved(spark: SparkSession, sf_dir: str, **hooks) -> DataFrame:
    inputs = materialize(targets(spark, sf_dir), "inputs")
    length = length_stats(inputs, ["goal"]).select("goal", F.floor("q2").cast("int").alias("length"))
    index = M.build_index(inputs, "seq_id", k=K, by=["goal"], store=True)
    best = evolve(inputs, "doc_id", length, index_scorer(index), STEPS, BATCH, BEST, MUTATIONS, SEED, **hooks)
    return best.select("goal", "seq_id", F.md5("seq").alias("seq_md5"),
                       F.round(F.col("reward").cast("double"), 4).alias("reward"), "pos")


@query("evolve_weighted", f"""WITH {INPUTS}, {evolve_sql(1, "inp", "doc_id", weighted=True)}
SELECT goal, seq_id, md5(seq) AS seq_md5, round(reward::DOUBLE, 4) AS reward, rn::INTEGER AS pos FROM gen1""")
def evolve_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents in proportion to their reward."""
    return evolved(spark, sf_dir, proposer=propose_weighted)


def select_sql(r: int) -> str:
    ref = "inp" if r == 1 else f"sel{r - 1}"
    comp = f"[{COMP_SQL}]"
    return f"""
gv{r} AS (SELECT goal, seq_id, seq, {comp} AS v FROM gen{r}),
rv{r} AS (SELECT goal, {comp} AS rv FROM {ref}),
near{r} AS (SELECT goal, seq_id, any_value(seq) AS seq, round(min(list_cosine_distance(v, rv)), 12) AS c,
    round(min(list_distance(v, rv)), 12) AS l FROM gv{r} JOIN rv{r} USING (goal) GROUP BY goal, seq_id),
rank{r} AS (SELECT *, (rank() OVER (PARTITION BY goal ORDER BY c DESC)
    + rank() OVER (PARTITION BY goal ORDER BY l DESC)) / 2.0 AS avg_rank FROM near{r}),
sel{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY avg_rank, seq_id) AS pos
    FROM rank{r}) WHERE pos <= {TOP})"""


def hits_sql(r: int) -> str:
    words = words_sql(f"gw{r}", f"sel{r}", "seq_id").replace(
        "SELECT DISTINCT seq_id, word", "SELECT DISTINCT goal, seq_id, word").replace(
        "SELECT seq_id, unnest", "SELECT goal, seq_id, unnest")
    return f"""
{words},
gh{r} AS (SELECT goal, seq_id, doc_id, count(*) AS shared FROM gw{r} JOIN iw USING (goal, word) GROUP BY ALL)"""


ROUNDS = 2
CAMPAIGN = f"{INPUTS}, " + ", ".join(
    evolve_sql(r, "inp" if r == 1 else f"sel{r - 1}", "doc_id" if r == 1 else "pos") + "," + select_sql(r)
    for r in range(1, ROUNDS + 1))


def campaign(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, **hooks) -> Campaign:
    docs = targets(spark, sf_dir) if docs is None else docs
    wild_type = docs.orderBy("doc_id").limit(1).select("seq").scalar()
    cfg = Settings(rounds=ROUNDS, steps=STEPS, batch_size=BATCH, num_sequences=BEST,
                   num_mutations=MUTATIONS, topk=TOP, k=K, seed=SEED, **hooks)
    return run_campaign(docs, wild_type, cfg, "doc_id")


@query("select_round", f"""WITH {CAMPAIGN},
picked AS ({" UNION ALL ".join(f"SELECT {r} AS round, * FROM sel{r}" for r in range(1, ROUNDS + 1))})
SELECT goal, round, seq_id, md5(seq) AS seq_md5, pos::INTEGER AS pos, avg_rank, round(c, 6) AS min_cos,
  round(l, 6) AS min_l2 FROM picked""")
def select_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign(spark, sf_dir).selected.select(
        "goal", "round", "seq_id", F.md5("seq").alias("seq_md5"), "pos", "avg_rank",
        r6("min_cos", "min_cos"), r6("min_l2", "min_l2"))


@query("round_eval", f"""WITH {CAMPAIGN}, {", ".join(hits_sql(r) for r in range(1, ROUNDS + 1))},
e AS ({" UNION ALL ".join(f'''SELECT goal, {r} AS round, min(c) AS cosine_min, max(c) AS cosine_max, avg(c) AS cosine_mean,
  min(l) AS l2_min, max(l) AS l2_max, avg(l) AS l2_mean FROM sel{r} GROUP BY goal''' for r in range(1, ROUNDS + 1))}),
s AS ({" UNION ALL ".join(f"SELECT goal, {r} AS round, min(shared) AS a, max(shared) AS b, avg(shared) AS m FROM gh{r} GROUP BY goal" for r in range(1, ROUNDS + 1))})
SELECT goal, round, {", ".join(f"round({n}, 6) AS {n}" for n in STAT_NAMES)},
  a::DOUBLE AS score_min, b::DOUBLE AS score_max, round(m, 6) AS score_mean FROM e LEFT JOIN s USING (goal, round)""")
def round_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = campaign(spark, sf_dir).evaluations
    return ev.select("goal", "round", *[r6(F.col(f"embedding.{n}"), n) for n in STAT_NAMES],
                     F.col("structure.min").alias("score_min"), F.col("structure.max").alias("score_max"),
                     r6(F.col("structure.mean"), "score_mean"))


def records_sql(r: int) -> str:
    words = words_sql(f"rw{r}", f"gen{r}", "seq_id").replace(
        "SELECT DISTINCT seq_id, word", "SELECT DISTINCT goal, seq_id, word").replace(
        "SELECT seq_id, unnest", "SELECT goal, seq_id, unnest")
    return f"""
{words},
rs{r} AS (SELECT goal, seq_id, avg(shared) AS score FROM (SELECT goal, seq_id, doc_id, count(*) AS shared
  FROM rw{r} JOIN iw USING (goal, word) GROUP BY ALL) GROUP BY ALL),
rd{r} AS (SELECT goal, seq_id, min(list_cosine_distance(v, rv)) AS c, min(list_distance(v, rv)) AS l
  FROM gv{r} JOIN rv1 USING (goal) GROUP BY goal, seq_id),
rec{r} AS (SELECT {r} AS round, goal, seq_id, seq, score, c, l FROM gen{r} LEFT JOIN rs{r} USING (goal, seq_id)
  LEFT JOIN rd{r} USING (goal, seq_id))"""


@query("campaign_records", f"""WITH {CAMPAIGN}, {", ".join(records_sql(r) for r in range(1, ROUNDS + 1))},
wild AS (SELECT seq AS wt FROM inp ORDER BY doc_id LIMIT 1)
SELECT round, goal, seq_id, md5(seq) AS seq_md5, length(seq)::INTEGER AS length, round(score, 6) AS mean_score, round(c, 6) AS min_cos,
  round(l, 6) AS min_l2, len(list_filter(range(1, least(length(seq), length(wt)) + 1), lambda i: substr(seq, i, 1) <> substr(wt, i, 1)))::INTEGER AS substitutions
FROM ({" UNION ALL ".join(f"SELECT * FROM rec{r}" for r in range(1, ROUNDS + 1))}), wild""")
def campaign_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every round, written to the records file and read back."""
    rows = campaign(spark, sf_dir).records.select(
        "round", "goal", "seq_id", F.md5("seq").alias("seq_md5"), "length", r6("mean_score", "mean_score"),
        r6("min_cos", "min_cos"), r6("min_l2", "min_l2"), "substitutions")
    return read_round_records(spark, write_round_records(rows), rows.schema)


def picky_model():
    """Letter shares, but no sequence of a single letter."""
    shares = composition_model()

    def predict(sequences):
        for s in sequences:
            if len(set(s)) < 2:
                raise ValueError("one letter only")
        return shares(sequences)
    return predict


@query("campaign_failures", f"""SELECT goal, {ROUNDS * TOP}::BIGINT AS n_selected, NULL::INTEGER AS round, NULL AS stage,
  NULL::BIGINT AS n_failed, NULL AS error FROM (SELECT DISTINCT lang AS goal FROM documents)
UNION ALL SELECT 'blank', 0, 0, 'inputs', count(*), 'no sequences' FROM documents WHERE source = 'src0'
UNION ALL SELECT 'broken', 0, 0, 'embed inputs', count(*), 'ValueError: one letter only' FROM ({SEQS.removeprefix("seqs AS (").removesuffix(")")})
  WHERE source = 'src1' AND length(seq) > 0""")
def campaign_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more targets: one whose sequences are empty, one that the model refuses."""
    docs = seqs(spark, sf_dir, keep_empty=True)

    def target(name: str, source: str, seq):
        return docs.where(F.col("source") == source).select(
            F.lit(name).alias("goal"), "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("seq_id"), seq.alias("seq"))
    blank, broken = target("blank", "src0", F.lit("")), target("broken", "src1", F.regexp_replace("seq", ".", "W"))
    inputs = targets(spark, sf_dir).unionByName(blank).unionByName(broken)
    done = campaign(spark, sf_dir, inputs, model=picky_model)
    goals = inputs.select("goal").distinct()
    picked = done.selected.groupBy("goal").agg(F.count(F.lit(1)).alias("n_selected"))
    return goals.join(picked, "goal", "left").join(done.failures, "goal", "left").select(
        "goal", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "round", "stage", "n_failed", "error")
