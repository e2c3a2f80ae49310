"""File formats: every table is written in the format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.batches import BUDGET, PACKED
from seqflow.catalog.hits import HITS, search_hits
from seqflow.catalog.registry import query, table
from seqflow.catalog.runs import HOUR_US, LOG, request_log
from seqflow.catalog.selection import r6
from seqflow.catalog.sequences import COMP_SQL, SEQS, seq_clean, seqs
from seqflow.functions import sequences as S
from seqflow.operators import accounting as A
from seqflow.operators.embed import embedding_udf, pool_parts
from seqflow.plans.embedding_job import embedding_job, job_metrics, rejected_rows, token_job
from seqflow.sources import embeddings as E, fasta, hits as H, runlogs as R


@query("fasta_scan", f"""WITH {SEQS}
SELECT 'doc_' || doc_id AS seq_id, length(seq)::INTEGER AS length, seq FROM seqs WHERE length(seq) > 0""")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write wrapped records, empty ones included; blank records drop on reading."""
    name = F.concat(F.lit("doc_"), F.col("doc_id"))
    path = fasta.write_fasta(seqs(spark, sf_dir, keep_empty=True), name, wrap=60)
    return fasta.read_fasta(spark, path).select("seq_id", F.length("seq").alias("length"), "seq")


@query("fasta_merge", f"""WITH {SEQS}
SELECT substr(source, 4)::INTEGER AS round, 'doc_' || doc_id AS seq_id, length(seq)::INTEGER AS length, md5(seq) AS seq_md5
FROM seqs WHERE length(seq) > 0""")
def fasta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files per round, merged by the equality of ``round``, not by name prefix."""
    rows = seqs(spark, sf_dir).withColumn("round", F.substring("source", 4, 9).cast("int"))
    path = fasta.write_fasta(rows, F.concat(F.lit("doc_"), F.col("doc_id")), partition_by=["round"])
    merged = fasta.read_fasta(spark, path)
    return merged.select(F.col("round").cast("int").alias("round"), "seq_id", F.length("seq").alias("length"),
                         F.md5("seq").alias("seq_md5"))


@query("fasta_scan_ordered", f"""WITH {SEQS}
SELECT row_number() OVER (ORDER BY substr(source, 4)::INTEGER, doc_id) - 1 AS ord, 'doc_' || doc_id AS seq_id, md5(seq) AS seq_md5
FROM seqs WHERE length(seq) > 0""")
def fasta_scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per source, records by id: positions over all files, by path and place in the file."""
    rows = seqs(spark, sf_dir)
    rows = rows.withColumn("part", F.format_string("%05d", F.substring("source", 4, 9).cast("int")))
    placed = rows.repartition("part").sortWithinPartitions("part", "doc_id")
    path = fasta.write_fasta(placed, F.concat(F.lit("doc_"), F.col("doc_id")), wrap=60, partition_by=["part"])
    back = fasta.read_fasta(spark, path, with_order=True)
    return back.select("ord", "seq_id", F.md5("seq").alias("seq_md5"))


@query("labels_scan", f"""WITH {SEQS} SELECT 'doc_' || doc_id AS label FROM seqs WHERE length(seq) > 0""")
def labels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the sequences, one a line, written and read back."""
    names = seq_clean(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"))
    return fasta.read_labels(spark, fasta.write_labels(names, "name"))


@query("hits_scan", f"""WITH {HITS}
SELECT query::VARCHAR AS query, target::VARCHAR AS target, round(fident, 6) AS fident, shared::DOUBLE AS bits,
       round(fident / 2, 6) AS alntmscore FROM hits""")
def hits_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search_hits(spark, sf_dir).select(
        "query", "target", "fident", F.col("shared").cast("double").alias("bits"),
        (F.col("fident") / 2).alias("alntmscore"))
    back = H.read_hits(spark, H.write_hits(hits, "struct5"), "struct5")
    return back.withColumn("fident", r6("fident")).withColumn("alntmscore", r6("alntmscore"))


@query("embedding_csv_scan", """SELECT vec_id::VARCHAR AS label, d::INTEGER AS dim, round(embedding[d + 1]::DOUBLE, 6) AS value
FROM embeddings, range(64) r(d)""")
def embedding_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    back = E.read_embedding_csv(spark, E.write_embedding_csv(emb, "label", "embedding", 64))
    return back.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", r6("value"))


@query("run_metrics_scan", f"""WITH {LOG}
SELECT 'run' || device AS run, (t // {HOUR_US} * 3600)::DOUBLE AS timestamp, count(*) AS requests,
  sum(tokens)::BIGINT AS tokens, count(*) FILTER (status <> 'error') AS processed
FROM log GROUP BY device, t // {HOUR_US}""")
def run_metrics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics object per run and day: at most 24 intervals each."""
    hours = request_log(spark, sf_dir).groupBy(
        "device", F.expr(f"t div {HOUR_US}").alias("h")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"),
        F.count_if(F.col("status") != "error").alias("ok"))
    gpu = F.create_map(F.lit("gpu0"), F.struct(F.col("ok").alias("processed")))
    line = F.struct((F.col("h") * 3600).cast("double").alias("timestamp"), F.lit(3600.0).alias("dt"), "requests",
                    "tokens", F.col("tokens").alias("total_tokens"), gpu.alias("gpu_stats"))
    runs = hours.groupBy("device", F.expr("h div 24").alias("day")).agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("total_tokens"),
        F.collect_list(line).alias("timeseries"))
    objects = runs.select(F.concat(F.lit("run"), "device").alias("run"), "requests", "total_tokens", "timeseries")
    intervals = R.metric_intervals(R.read_run_metrics(spark, R.write_json(objects)))
    return intervals.select("run", "timestamp", "requests", "tokens",
                            F.col("gpu_stats")["gpu0"]["processed"].alias("processed"))


@query("client_summary_scan", f"""WITH {LOG}
SELECT 'run' || device AS run, count(*) AS submitted, count(*) FILTER (status <> 'error') AS successful,
  count(*) FILTER (status = 'error') AS failed, sum(k % 3)::BIGINT AS retries,
  (count(DISTINCT message) FILTER (status = 'error'))::INTEGER AS n_messages FROM log GROUP BY device""")
def client_summary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message list holds distinct codes, of which there are ten."""
    log = request_log(spark, sf_dir).withColumn("retries", F.col("k") % 3)
    msgs = A.error_messages(log, ["device"]).groupBy("device").agg(F.sort_array(F.collect_list("message")).alias("error_msgs"))
    objects = A.outcome_rollup(log, ["device"]).join(msgs, "device", "left").select(
        F.concat(F.lit("run"), "device").alias("run"), "submitted", "successful", "failed", "error_msgs", "retries")
    back = R.read_client_outcomes(spark, R.write_json(objects))
    return back.select("run", "submitted", "successful", "failed", "retries", F.size("error_msgs").alias("n_messages"))


@query("telemetry_scan", f"""WITH {LOG},
s AS (SELECT 'node' || (user_id % 4) AS host, t // 1000000 AS sec, k % 8 AS gpu, value FROM log),
b AS (SELECT host, unnest([sec, sec + 5]) AS timestamp, gpu, unnest([value, value / 2]) AS v FROM s)
SELECT host, timestamp::BIGINT AS timestamp, gpu::INTEGER AS gpu, 'utilization' AS gauge, v AS value FROM b
UNION ALL SELECT host, timestamp, gpu, 'power_watts', v * 2 FROM b
UNION ALL SELECT host, timestamp, NULL, 'cpu_percent', v FROM b""")
def telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint objects with two samples each and dynamic gauge keys."""
    log = request_log(spark, sf_dir)
    host = F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string"))
    sec = F.expr("t div 1000000")
    gpu = (F.col("k") % 8).cast("string")

    def sample(at, v):
        gauges = F.create_map(F.concat(F.lit("gpu_"), gpu, F.lit("_utilization")), v,
                              F.concat(F.lit("gpu_"), gpu, F.lit("_power_watts")), v * 2, F.lit("cpu_percent"), v)
        return F.struct(at.alias("timestamp"), host.alias("hostname"), gauges.alias("metrics"))

    objects = log.select(
        F.struct(host.alias("hostname"), sec.alias("timestamp"), F.lit(0.2).alias("collection_rate"),
                 F.lit(2).alias("num_samples")).alias("checkpoint_metadata"),
        F.array(sample(sec, F.col("value")), sample(sec + 5, F.col("value") / 2)).alias("metrics"))
    back = R.telemetry_samples(R.read_telemetry(spark, R.write_json(objects)))
    return back.drop("ts")


JOB = f"""{PACKED},
placed AS (SELECT tok.*, row_number() OVER (PARTITION BY source, batch_no ORDER BY doc_id) - 1 AS seq_idx FROM tok),
cut AS (SELECT doc_id, source, substr(seq, 1, {S.MAX_TOKENS - S.SPECIAL_TOKENS}) AS seq FROM seqs),
emb AS (SELECT p.*, [{COMP_SQL}] AS v FROM placed p JOIN cut USING (doc_id, source))"""


def run_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_job(seqs(spark, sf_dir).select("source", "doc_id", "seq"), BUDGET, ["source"], "doc_id")


@query("saved_embeddings", f"""WITH RECURSIVE {JOB}
SELECT source, batch_no, seq_idx::INTEGER AS seq_idx, doc_id, {", ".join(f"round(v[{i + 1}], 6) AS e{i}" for i in range(20))} FROM emb""")
def saved_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = run_job(spark, sf_dir)
    return stored.select("source", "batch_no", "seq_idx", "doc_id",
                         *[r6(F.col("embedding")[i], f"e{i}") for i in range(20)])


@query("embedding_job", f"""WITH RECURSIVE {JOB},
per_batch AS (SELECT source, batch_no, count(*) AS n, sum(n_tokens) AS tok FROM emb GROUP BY ALL)
SELECT source, count(*) AS requests, sum(n)::BIGINT AS sequences, sum(tok)::BIGINT AS total_tokens FROM per_batch GROUP BY source""")
def embedding_job_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_metrics(run_job(spark, sf_dir), ["source"])


PART_ROWS = 256
TOKENS = f"""{PACKED}, placed AS (
  SELECT tok.*, row_number() OVER (PARTITION BY source, batch_no ORDER BY doc_id) - 1 AS seq_idx FROM tok),
ids AS (SELECT p.source, batch_no, seq_idx, doc_id, list_append(list_transform(range(1, n_tokens - 1),
    lambda i: strpos('{S.ALPHABET}', substr(seq, i, 1)) - 1), {S.END_ID}) AS ids FROM placed p JOIN seqs USING (doc_id, source)),
vec AS (SELECT * EXCLUDE (ids), i - 1 AS place, (i - 1) // {PART_ROWS} AS part, ids[i] / 32 AS v0, coalesce(ids[i + 1], 0) / 32 AS v1,
    (i - 1) / 1024 AS v2, (i = len(ids))::INTEGER::DOUBLE AS v3 FROM ids, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i))"""
_DIMS = range(4)


def run_token_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seqs(spark, sf_dir).select("source", "doc_id", "seq")
    return token_job(rows, BUDGET, ["source"], "doc_id", part_bytes=PART_ROWS * 8 * len(_DIMS))


@query("token_embeddings", f"""WITH RECURSIVE {TOKENS}
SELECT source, batch_no, seq_idx::INTEGER AS seq_idx, doc_id, part::INTEGER AS part, min(place)::INTEGER AS start, count(*)::INTEGER AS n,
  {", ".join(f"round(sum(v{i}), 6) AS s{i}" for i in _DIMS)} FROM vec GROUP BY ALL""")
def token_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per token, stored in parts of 256 tokens; the sums of each part's vectors."""
    def total(i: int):
        return F.aggregate("vectors", F.lit(0.0), lambda a, v: a + v[i])
    return run_token_job(spark, sf_dir).select(
        "source", "batch_no", "seq_idx", "doc_id", "part", "start", F.size("vectors").alias("n"), *[r6(total(i), f"s{i}") for i in _DIMS])


@query("token_pool", f"""WITH RECURSIVE {TOKENS}
SELECT doc_id, count(*)::INTEGER AS n_rows, {", ".join(f"round(avg(v{i}), 6) AS e{i}" for i in _DIMS)} FROM vec GROUP BY doc_id""")
def token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the stored token vectors of each sequence."""
    pooled = pool_parts(run_token_job(spark, sf_dir), ["doc_id"])
    return pooled.select("doc_id", "n_rows", *[r6(F.col("embedding")[i], f"e{i}") for i in _DIMS])


@query("rejected_rows", f"""WITH {SEQS} SELECT source, doc_id, length(seq)::INTEGER AS n,
  CASE WHEN length(seq) = 0 THEN 'empty' ELSE 'oversize' END AS reason FROM seqs WHERE length(seq) = 0 OR length(seq) > {BUDGET}""")
def rejected_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the embedding job leaves out, and why."""
    return rejected_rows(seqs(spark, sf_dir, keep_empty=True), BUDGET, ["source", "doc_id"])


@query("embed_udf", f"""WITH {SEQS}, e AS (SELECT doc_id, [{COMP_SQL}] AS v FROM seqs WHERE length(seq) > 0)
SELECT doc_id, {", ".join(f"round(v[{i + 1}], 6) AS e{i}" for i in range(20))} FROM e""")
def embed_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors through the model hook."""
    embed = embedding_udf()
    emb = seq_clean(spark, sf_dir).select("doc_id", embed("seq").alias("v"))
    return emb.select("doc_id", *[r6(F.col("v")[i], f"e{i}") for i in range(20)])
