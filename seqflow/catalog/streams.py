"""Streaming queries: the table is read as a file stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.batches import BUDGET, PACKED
from seqflow.catalog.registry import query, table
from seqflow.catalog.runs import HOUR_US, LOG
from seqflow.catalog.selection import r6
from seqflow.catalog.sequences import COMP_SQL, SEQS
from seqflow.functions import sequences as S
from seqflow.session import scratch_path
from seqflow.sources import runlogs as R
from seqflow.streaming import jobs as J
from seqflow.streaming.drain import Ledger, counted, drain_append, drain_update, file_stream, table_stream
from seqflow.streaming.stateful import first_completions, pack_keyed, rocksdb


WAVES = 3


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log; event time must be a zoned timestamp."""
    ev = table_stream(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        (F.col("user_id") % 8).alias("device"), F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.col("event_type").alias("kind"), "value", F.round(F.col("value") * 100).cast("bigint").alias("tokens"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def plain(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_rates", f"""WITH {LOG}
SELECT device, make_timestamp(t // {HOUR_US} * {HOUR_US}) AS start, count(*) AS requests, sum(tokens)::BIGINT AS tokens,
  round(count(*) / 3600, 9) AS req_per_sec, round(sum(tokens) / 3600, 9) AS tok_per_sec
FROM log GROUP BY device, t // {HOUR_US}""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = J.rates(event_stream(spark, sf_dir), "ts", ["device"], "tokens", "1 hour", "2 hours")
    out = drain_update(rates, ["device", "start"])
    return out.select("device", plain("start"), "requests", "tokens", F.round("req_per_sec", 9).alias("req_per_sec"),
                      F.round("tok_per_sec", 9).alias("tok_per_sec"))


@query("stream_telemetry", f"""WITH {LOG}
SELECT 'node' || (user_id % 4) AS host, make_timestamp(t // {HOUR_US} * {HOUR_US}) AS start, count(*) AS num_samples,
  round(avg(value), 6) AS avg, max(value) AS max FROM log GROUP BY user_id % 4, t // {HOUR_US}""")
def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = J.telemetry_windows(event_stream(spark, sf_dir), "ts", ["host"], "value", "1 hour", "2 hours")
    return drain_update(win, ["host", "start"]).select("host", plain("start"), "num_samples", r6("avg", "avg"), "max")


@query("stream_device_counts", f"""WITH {LOG}
SELECT device, count(*) AS requests, count(*) FILTER (status = 'error') AS errors,
  count(*) FILTER (status <> 'error') AS processed FROM log GROUP BY device""")
def stream_device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = J.device_counts(event_stream(spark, sf_dir), ["device"], F.col("kind") == "error")
    return drain_update(counts, ["device"])


@query("stream_first_completion", f"""WITH {LOG}
SELECT event_id - k % 5 AS request_id, make_timestamp(min(t)) AS first_at, arg_min(kind, (t, kind)) AS kind
FROM log GROUP BY event_id - k % 5""")
def stream_first_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five completions of a request; its later ones arrive in earlier micro-batches."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    ev = table(spark, sf_dir, "events").select(
        (F.col("event_id") - k).alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
        F.when(k > 2, 0).when(k > 0, 1).otherwise(2).alias("wave"))
    last = ev.agg(F.max("ts").alias("ts")).select(
        F.lit(-1000).cast("bigint").alias("request_id"), (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"), F.lit("end").alias("kind"))
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("waves", "stream-ckpt", "stream-out"))
    columns = ["request_id", "ts", "kind"]
    ev.select(*columns).limit(0).write.parquet(inbox)
    stream = file_stream(spark, inbox, "request_id bigint, ts timestamp, kind string")
    first = first_completions(stream, "request_id", "ts", "kind", "3650 days")
    with rocksdb(spark):
        for wave in [ev.where(F.col("wave") == w).select(*columns) for w in range(WAVES)] + [last]:
            wave.write.mode("append").parquet(inbox)
            rows = drain_append(first, checkpoint, out)
    return rows.where("request_id <> -1000").select("request_id", plain("first_at"), "kind")


@query("stream_timeouts", f"""WITH {LOG},
done AS (SELECT event_id + k % 3 AS request_id, t + k * 60000000::BIGINT AS done FROM log WHERE kind <> 'signup')
SELECT event_id AS request_id, (max(done) IS NULL) AS timed_out, count(done) AS n_done
FROM log LEFT JOIN done ON request_id = event_id AND done >= t AND done <= t + 3600000000
GROUP BY event_id""")
def stream_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks; most events also complete a near-by request k minutes later."""
    asked = event_stream(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    done = event_stream(spark, sf_dir).where("kind <> 'signup'").select(
        (F.col("event_id") + F.col("k") % 3).alias("request_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("k"))).alias("at"))
    last = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("at"))
    marker = last.select(F.lit(-1).cast("bigint").alias("request_id"), (F.col("at") + F.expr("INTERVAL 10 DAYS")).alias("at"))
    rows = J.drain_timeouts(asked, done, "1 HOUR", "1 hour", marker)
    return rows.groupBy("request_id").agg(F.bool_and("timed_out").alias("timed_out"), F.count("done").alias("n_done"))


@query("stream_embed", f"""WITH {SEQS}
SELECT doc_id, length(seq)::INTEGER AS n, {", ".join(f"round(([{COMP_SQL}])[{i + 1}], 6) AS e{i}" for i in range(20))}
FROM seqs WHERE length(seq) > 0""")
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = drain_append(J.embed_stream(table_stream(spark, sf_dir, "documents"), "doc_id", "text"))
    return emb.select("doc_id", "n", *[r6(F.col("embedding")[i], f"e{i}") for i in range(20)])


@query("stream_token_batches", f"WITH RECURSIVE {PACKED} SELECT source, doc_id, n::BIGINT AS n, batch_no FROM packed")
def stream_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_stream(spark, sf_dir, "documents").where(S.has_residue("text")).select(
        "source", "doc_id", F.length(S.clean("text")).alias("n"))
    return J.pack_stream(docs, "doc_id", "n", BUDGET, ["source"])


@query("stream_batches_resumed", f"WITH RECURSIVE {PACKED} SELECT source, doc_id, n::BIGINT AS n, batch_no FROM packed")
def stream_batches_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint: the second starts with the batches that the first left open."""
    docs = table(spark, sf_dir, "documents").where(S.has_residue("text")).select(
        "source", "doc_id", F.length(S.clean("text")).alias("n"))
    half = (docs.agg(F.max("doc_id")).first()[0] or 0) // 2
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("feed", "pack-ckpt", "packed"))
    docs.limit(0).write.parquet(inbox)
    for part in (docs.where(F.col("doc_id") <= half), docs.where(F.col("doc_id") > half)):
        part.write.mode("append").parquet(inbox)
        rows = pack_keyed(file_stream(spark, inbox, docs.schema), "doc_id", "n", BUDGET, ["source"], checkpoint, out)
    return rows.where("batch_no IS NOT NULL")


LATE = f"""{LOG},
e AS (SELECT t, least((t + k * 3600000000::BIGINT * 3 - lo) * {WAVES} // (hi - lo + 1), {WAVES - 1}) AS wave
      FROM log, (SELECT min(t) AS lo, max(t) AS hi FROM log)),
wm AS (SELECT wave, max(t) AS top FROM e GROUP BY wave),
kept AS (SELECT e.t FROM e LEFT JOIN (SELECT w.wave + 1 AS wave, max(p.top) - 7200000000 AS wm
                                      FROM wm w JOIN wm p ON p.wave <= w.wave GROUP BY w.wave) m USING (wave)
         WHERE wm IS NULL OR (t // {HOUR_US} + 1) * {HOUR_US} > wm // 1000 * 1000)"""


@query("stream_late_drop", f"""WITH {LATE}
SELECT make_timestamp(t // {HOUR_US} * {HOUR_US}) AS start, count(*) AS n FROM kept GROUP BY t // {HOUR_US}""")
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive up to twelve days late, in waves that are drained in turn.

    A row is dropped if its window had ended before the watermark that the
    earlier waves left behind.
    """
    return late_windows(spark, sf_dir)


def late_windows(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    t = F.unix_micros("ts")
    span = ev.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    arrival = F.expr(f"(unix_micros(ts) + k * 3600000000L * 3 - {span['lo']}L) * {WAVES} div {span['hi'] - span['lo'] + 1}L")
    staged = ev.withColumn("wave", F.least(arrival, F.lit(WAVES - 1)))
    inbox = scratch_path(spark, "waves")
    staged.select("ts").limit(0).write.parquet(inbox)

    def release(wave: int):
        return lambda: staged.where(F.col("wave") == wave).select("ts").write.mode("append").parquet(inbox)

    counts = J.windowed_counts(counted(file_stream(spark, inbox, "ts timestamp"), name), "ts", "1 hour", "2 hours")
    return drain_update(counts, ["start"], [release(w) for w in range(WAVES)]).select(plain("start"), "n")


@query("stream_drop_count", f"""WITH {LATE}
SELECT (SELECT count(*) FROM e) AS rows_in, count(*) AS rows_kept, (SELECT count(*) FROM e) - count(*) AS rows_dropped FROM kept""")
def stream_drop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows came too late, from the ledger of all micro-batches."""
    with Ledger(spark) as ledger:
        kept = late_windows(spark, sf_dir).agg(F.sum("n").alias("rows_kept"))
    came = ledger.total("events", "rows").withColumnRenamed("rows", "rows_in")
    return came.select("rows_in", kept.scalar().alias("rows_kept")).withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept"))


@query("stream_telemetry_files", f"""WITH {LOG},
s AS (SELECT 'node' || (user_id % 4) AS host, t // 1000000 AS sec, value FROM log),
b AS (SELECT host, sec AS moment, value AS v FROM s UNION ALL SELECT host, sec + 5, value / 2 FROM s)
SELECT host, g AS gauge, make_timestamp(moment // 3600 * 3600 * 1000000) AS start, count(*) AS num_samples,
  round(sum(v * f), 3) AS total, round(max(v * f), 6) AS max
FROM b, (VALUES ('cpu_percent', 1), ('power_watts', 2)) q(g, f) GROUP BY host, g, moment // 3600""")
def stream_telemetry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint objects, one file after another as they arrive, one file to a micro-batch."""
    ev = table(spark, sf_dir, "events")
    host = F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string"))
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))

    def sample(at, v):
        gauges = F.create_map(F.lit("cpu_percent"), v, F.lit("gpu_0_power_watts"), v * 2)
        return F.struct(at.alias("timestamp"), host.alias("hostname"), gauges.alias("metrics"))

    objects = ev.select(
        F.struct(host.alias("hostname"), sec.alias("timestamp"), F.lit(2).cast("bigint").alias("num_samples")).alias("checkpoint_metadata"),
        F.array(sample(sec, F.col("value")), sample(sec + 5, F.col("value") / 2)).alias("metrics"))
    path = R.write_json(objects.repartitionByRange(4, F.col("checkpoint_metadata.timestamp")))
    samples = R.telemetry_samples(R.stream_telemetry(spark, path, max_files_per_trigger=1))
    windows = J.telemetry_windows(samples, "ts", ["host", "gauge"], "value", "1 hour", "400 days")
    out = drain_update(windows, ["host", "gauge", "start"])
    total = F.round(F.col("avg") * F.col("num_samples"), 3)
    return out.select("host", "gauge", plain("start"), "num_samples", total.alias("total"), r6("max", "max"))
