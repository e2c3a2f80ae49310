"""Token-budget batches over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.registry import query, table
from seqflow.catalog.selection import r6
from seqflow.catalog.sequences import CLEAN, SEQS, seqs
from seqflow.functions import sequences as S
from seqflow.operators import batching
from seqflow.operators.packing import pack
from seqflow.operators.population import resample_fill
from seqflow.operators.stats import pad_to_longest

BUDGET = 16000

# Greedy packing in SQL: one recursive step per row of each source.
PACKED = f"""{SEQS},
fit AS (SELECT source, doc_id, length(seq) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
        FROM seqs WHERE length(seq) > 0 AND length(seq) <= {BUDGET}),
packed AS (
  SELECT source, doc_id, n, rn, n AS used, 0::BIGINT AS batch_no FROM fit WHERE rn = 1
  UNION ALL
  SELECT f.source, f.doc_id, f.n, f.rn,
         CASE WHEN p.used + f.n > {BUDGET} THEN f.n ELSE p.used + f.n END,
         CASE WHEN p.used + f.n > {BUDGET} THEN p.batch_no + 1 ELSE p.batch_no END
  FROM packed p JOIN fit f ON f.source = p.source AND f.rn = p.rn + 1),
tok AS (SELECT *, least(n + 2, {S.MAX_TOKENS}) AS n_tokens FROM packed)"""
TOTALS = """totals AS (
  SELECT source, batch_no, count(*) AS n_seqs, sum(n_tokens)::BIGINT AS n_tokens,
         max(n_tokens)::INTEGER AS width FROM tok GROUP BY source, batch_no)"""


BENCH = f"bench AS (SELECT item_id, {CLEAN} AS seq FROM benchmark)"


def bench_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", S.clean("text").alias("seq"))


def packed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seqs(spark, sf_dir).select("source", "doc_id", F.length("seq").alias("n"))
    out = pack(rows, "doc_id", "n", BUDGET, ["source"])
    return out.withColumn("n_tokens", F.least(F.col("n") + S.SPECIAL_TOKENS, F.lit(S.MAX_TOKENS)))


@query("token_batches", f"WITH RECURSIVE {PACKED} SELECT source, doc_id, n::BIGINT AS n, batch_no FROM packed")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_docs(spark, sf_dir).drop("n_tokens")


@query("token_batches_chunked", f"""WITH RECURSIVE {PACKED.replace("(PARTITION BY source ORDER BY doc_id)", "(PARTITION BY '' ORDER BY doc_id)").replace(
    "f.source = p.source AND ", "")} SELECT doc_id, n::BIGINT AS n, batch_no FROM packed""")
def token_batches_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one lane, in parts of 50 rows, scanned as a tree of four functions a task."""
    rows = seqs(spark, sf_dir).select("doc_id", F.length("seq").alias("n"))
    return pack(rows, "doc_id", "n", BUDGET, chunk_rows=50, fan=4)


@query("batch_tokens", f"WITH RECURSIVE {PACKED}, {TOTALS} SELECT source, batch_no, n_seqs, n_tokens FROM totals")
def batch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = batching.batch_totals(packed_docs(spark, sf_dir), ["source", "batch_no"])
    return t.select("source", "batch_no", "n_seqs", "n_tokens")


@query("padding_waste", f"""WITH RECURSIVE {PACKED}, {TOTALS}
SELECT source, batch_no, n_seqs, n_tokens, width, n_seqs * width AS padded,
       round((n_seqs * width - n_tokens) / (n_seqs * width), 6) AS waste FROM totals""")
def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = batching.batch_totals(packed_docs(spark, sf_dir), ["source", "batch_no"])
    return t.withColumn("waste", r6("waste"))


@query("batch_payload", f"""WITH RECURSIVE {PACKED}, {TOTALS},
asked AS (SELECT DISTINCT source, b AS batch_no FROM documents, range(0, (SELECT max(batch_no) + 1 FROM totals)) r(b))
SELECT source, batch_no, n_seqs, n_tokens, n_seqs IS NOT NULL AS found
FROM asked LEFT JOIN totals USING (source, batch_no)""")
def batch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask every source for as many batches as the largest has; the others have fewer."""
    t = batching.batch_totals(packed_docs(spark, sf_dir), ["source", "batch_no"])
    batches = t.select(F.concat_ws("/", "source", "batch_no").alias("batch_id"), "n_seqs", "n_tokens")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    last = t.agg(F.max("batch_no")).first()[0] or 0
    asked = sources.withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    asked = asked.withColumn("batch_id", F.concat_ws("/", "source", "batch_no"))
    return batching.batch_payload(asked, batches).drop("batch_id")


@query("missing_batches", f"""WITH RECURSIVE {PACKED}, {TOTALS},
asked AS (SELECT DISTINCT source, b AS batch_no FROM documents, range(0, (SELECT max(batch_no) + 1 FROM totals)) r(b))
SELECT source, batch_no FROM asked ANTI JOIN totals USING (source, batch_no)""")
def missing_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the batches that every source is asked for don't exist."""
    asked = batch_payload(spark, sf_dir)
    batches = asked.where("found").select(F.concat_ws("/", "source", "batch_no").alias("batch_id"))
    named = asked.select(F.concat_ws("/", "source", "batch_no").alias("batch_id"), "source", "batch_no")
    return batching.missing_batches(named, batches).select("source", "batch_no")


@query("seq_pad_longest", f"""WITH {BENCH}, top AS (SELECT max(length(seq))::INTEGER AS n FROM bench)
SELECT item_id, rpad(seq, n, '{S.PAD}') AS seq FROM bench, top""")
def seq_pad_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a given length, the longest sequence sets it."""
    return pad_to_longest(bench_seqs(spark, sf_dir))


@query("budget_cutoff", f"""WITH {SEQS},
s AS (SELECT doc_id, length(seq) AS n FROM seqs),
run AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
               (SELECT sum(length(seq)) FROM seqs) AS total FROM s)
SELECT doc_id, n::INTEGER AS n, seen::BIGINT AS seen FROM run WHERE seen <= total // 2""")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop after half of all residues have been produced."""
    rows = seqs(spark, sf_dir, keep_empty=True).select("doc_id", F.length("seq").alias("n"))
    total = rows.agg(F.sum("n")).first()[0]
    return batching.budget_cutoff(rows, "doc_id", F.col("n"), total // 2)


@query("round_robin", """SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 7)::INTEGER AS endpoint,
  ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3)::INTEGER AS slot FROM events""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    out = batching.round_robin(ev, "event_id", 7, name="endpoint")
    return batching.round_robin(out, "event_id", 3, ["user_id"]).drop("user_id")


@query("fixed_groups", """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS grp FROM events""")
def fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.fixed_groups(table(spark, sf_dir, "events").select("event_id"), "event_id", 64)


@query("cycled_source", f"""WITH {BENCH} SELECT c::INTEGER AS cycle, item_id, seq FROM bench, range(3) r(c)""")
def cycled_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.cycle(bench_seqs(spark, sf_dir), 3)


@query("replicated_batches", f"""WITH {BENCH}, one AS (
  SELECT count(*) AS n_seqs, sum(least(length(seq) + 2, {S.MAX_TOKENS}))::BIGINT AS n_tokens FROM bench)
SELECT b::INTEGER AS batch_id, n_seqs, n_tokens FROM one, range(10) r(b)""")
def replicated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = bench_seqs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_seqs"),
                                        F.sum(S.n_tokens("seq")).cast("bigint").alias("n_tokens"))
    return batching.replicate_batch(one, 10).select("batch_id", "n_seqs", "n_tokens")


@query("resample_fill", f"""WITH {BENCH}, src AS (
  SELECT item_id, seq, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM bench),
want AS (SELECT n * 3 AS total, n FROM src LIMIT 1),
extra AS (SELECT r.i AS pos, ('0x' || substr(md5('42|' || r.i), 1, 8))::BIGINT % n AS pick
          FROM want, unnest(range(n, total)) AS r(i))
SELECT pos, item_id, seq FROM src
UNION ALL SELECT e.pos, s.item_id, s.seq FROM extra e JOIN src s ON s.pos = e.pick""")
def resample_fill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill the benchmark up to three times its size by hashed re-sampling."""
    src = bench_seqs(spark, sf_dir)
    return resample_fill(src, "item_id", 3 * src.count(), seed=42)
