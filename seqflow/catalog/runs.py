"""Run accounting on ``events`` (a request log) and ``lineitem`` (an attempt log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.registry import query, table
from seqflow.catalog.selection import r6
from seqflow.operators import accounting as A

HOUR_US = 3_600_000_000
TIMEOUT = 30.0

LOG = """log AS (
  SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + (round(value * 100)::BIGINT * 600000) AS t_end,
    user_id, user_id % 8 AS device, event_type AS kind, value, round(value * 100)::BIGINT AS tokens,
    (props->>'k')::INTEGER AS k, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
    'code ' || ((props->>'k')::INTEGER % 10) AS message FROM events)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in microseconds; device from the user, tokens from the value."""
    tokens = F.round(F.col("value") * 100).cast("bigint")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", t.alias("t"), (t + tokens * 600000).alias("t_end"), "user_id",
        (F.col("user_id") % 8).alias("device"), F.col("event_type").alias("kind"), "value",
        tokens.alias("tokens"), k.alias("k"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.concat(F.lit("code "), (k % 10).cast("string")).alias("message"))


@query("interval_rates", f"""WITH {LOG},
h AS (SELECT device, t // {HOUR_US} AS h, count(*) AS n, sum(tokens) AS tok FROM log GROUP BY ALL),
span AS (SELECT device, unnest(range(min(h), max(h) + 1)) AS h FROM h GROUP BY device),
lines AS (SELECT device, h + 1 AS ts,
            sum(coalesce(n, 0)) OVER w AS requests, sum(coalesce(tok, 0)) OVER w AS tokens
          FROM span LEFT JOIN h USING (device, h) WINDOW w AS (PARTITION BY device ORDER BY h)),
d AS (SELECT *, requests - coalesce(lag(requests) OVER w, 0) AS d_requests,
             tokens - coalesce(lag(tokens) OVER w, 0) AS d_tokens
      FROM lines WINDOW w AS (PARTITION BY device ORDER BY ts)),
m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) AS hours FROM d WHERE d_requests <> 0 OR d_tokens <> 0)
SELECT device, ts::BIGINT AS ts, d_requests::BIGINT AS d_requests, d_tokens::BIGINT AS d_tokens,
  (hours * 3600)::DOUBLE AS dt, round(d_requests / (hours * 3600), 9) AS req_per_sec,
  round(d_tokens / (hours * 3600), 9) AS tok_per_sec FROM m""")
def interval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counter lines per device, idle hours included, then their rates."""
    log = request_log(spark, sf_dir)
    hours = log.groupBy("device", F.expr(f"t div {HOUR_US}").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tok"))
    span = hours.groupBy("device").agg(F.min("h").alias("a"), F.max("h").alias("b")).select(
        "device", F.explode(F.sequence("a", "b")).alias("h"))
    lines = span.join(hours, ["device", "h"], "left").select(
        "device", (F.col("h") * 3600 + 3600).alias("ts"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("tok", F.lit(0)).alias("tok"))
    run = A.prefix_sums(lines, "ts", {"requests": F.col("n"), "tokens": F.col("tok")}, ["device"])
    totals = run.select("device", "ts", (F.col("requests") + F.col("n")).alias("requests"),
                        (F.col("tokens") + F.col("tok")).alias("tokens"))
    rates = A.interval_rates(totals, by=["device"])
    return rates.select("device", F.expr("ts div 3600").alias("ts"), "d_requests", "d_tokens", "dt",
                        F.round("req_per_sec", 9).alias("req_per_sec"),
                        F.round("tok_per_sec", 9).alias("tok_per_sec"))


@query("inflight", f"""WITH {LOG},
e AS (SELECT t, 1 AS n, tokens FROM log UNION ALL SELECT t_end, -1, -tokens FROM log),
g AS (SELECT t, sum(n) AS n, sum(tokens) AS tokens FROM e GROUP BY t)
SELECT t, (sum(n) OVER (ORDER BY t))::BIGINT AS in_flight, (sum(tokens) OVER (ORDER BY t))::BIGINT AS queue_tokens FROM g""")
def inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.in_flight(request_log(spark, sf_dir), "t", "t_end", "tokens")


@query("step_times", f"""WITH {LOG}
SELECT user_id, event_id, t - coalesce(lag(t) OVER w, t) AS step, t - first_value(t) OVER w AS total
FROM log WINDOW w AS (PARTITION BY user_id ORDER BY t)""")
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).select("user_id", "event_id", "t")
    return A.step_times(log, "t", ["user_id"]).drop("t")


@query("timeout_flag", f"""WITH {LOG} SELECT event_id, value > least(k::DOUBLE, {TIMEOUT}) AS timed_out FROM log""")
def timeout_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = A.timed_out(F.col("value"), F.col("k").cast("double"), TIMEOUT)
    return request_log(spark, sf_dir).select("event_id", late.alias("timed_out"))


@query("request_match", f"""WITH {LOG},
done AS (SELECT event_id - k % 5 AS request_id, t AS done_t, status FROM log),
firsts AS (SELECT request_id, min(done_t) AS done_t, arg_min(status, done_t) AS status FROM done GROUP BY request_id)
SELECT event_id AS request_id, user_id AS batch_id, done_t, f.status, done_t - t AS waited
FROM log LEFT JOIN firsts f ON f.request_id = log.event_id""")
def request_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event also completes a slightly older request; duplicates occur."""
    log = request_log(spark, sf_dir)
    done = log.select((F.col("event_id") - F.col("k") % 5).alias("request_id"),
                      F.col("t").alias("done_t"), "status")
    asked = log.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("batch_id"), "t")
    return (A.match_requests(asked, done, "done_t", ["status"])
            .withColumn("waited", F.col("done_t") - F.col("t")).drop("t"))


@query("outcome_rollup", f"""WITH {LOG}
SELECT device, count(*) AS submitted, count(*) FILTER (status <> 'error') AS successful,
  count(*) FILTER (status = 'error') AS failed, sum(k % 3)::BIGINT AS retries FROM log GROUP BY device""")
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcome_rollup(request_log(spark, sf_dir).withColumn("retries", F.col("k") % 3), ["device"])


@query("error_messages", f"""WITH {LOG}
SELECT device, message, count(*) AS n FROM log WHERE status = 'error' GROUP BY device, message""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.error_messages(request_log(spark, sf_dir), ["device"])


@query("device_counts", f"""WITH {LOG}
SELECT device, count(*) FILTER (status <> 'error') AS processed, count(*) FILTER (status = 'error') AS errors,
  sum(tokens)::BIGINT AS tokens FROM log GROUP BY device""")
def device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).groupBy("device").agg(
        F.count_if(F.col("status") != "error").alias("processed"),
        F.count_if(F.col("status") == "error").alias("errors"), F.sum("tokens").alias("tokens"))


@query("load_snapshot", f"""WITH {LOG}, mid AS (SELECT (min(t) + max(t)) // 2 AS snap FROM log)
SELECT device, count(*) AS total, count(*) FILTER (t <= snap AND t_end > snap) AS busy,
  count(*) FILTER (t > snap) AS waiting, count(*) FILTER (t_end <= snap) AS processed FROM log, mid GROUP BY device""")
def load_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of every device half-way through the log."""
    log = request_log(spark, sf_dir)
    mid = log.agg(F.expr("(min(t) + max(t)) div 2").alias("snap")).first()["snap"]
    return A.load_snapshot(log, F.lit(mid), "t", "t_end", ["device"])


@query("telemetry_rollup", f"""WITH {LOG},
s AS (SELECT 'node' || (user_id % 4) AS host, k % 8 AS gpu, unnest(['utilization', 'power_watts']) AS gauge,
             unnest([value, value * 2]) AS value, t FROM log)
SELECT host, gpu, gauge, make_timestamp((t // {HOUR_US}) * {HOUR_US}) AS bucket, round(avg(value), 6) AS avg,
  max(value) AS max, min(value) AS min, count(*) AS n FROM s GROUP BY host, gpu, gauge, t // {HOUR_US}""")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gauges = F.inline(F.array(
        F.struct(F.lit("utilization").alias("gauge"), F.col("value")),
        F.struct(F.lit("power_watts").alias("gauge"), (F.col("value") * 2).alias("value"))))
    samples = request_log(spark, sf_dir).select(
        F.concat(F.lit("node"), (F.col("user_id") % 4).cast("string")).alias("host"),
        (F.col("k") % 8).alias("gpu"), F.timestamp_micros("t").alias("ts"), gauges)
    out = A.telemetry_rollup(samples, ["host", "gpu", "gauge"])
    return out.withColumn("avg", r6("avg")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("scaling_efficiency", f"""WITH {LOG},
r AS (SELECT (1 << (user_id % 4))::BIGINT AS gpus, count(*) AS n, (max(t) - min(t)) / 60000000.0::DOUBLE AS minutes
      FROM log GROUP BY 1),
b AS (SELECT n / minutes AS thr FROM r WHERE gpus = 1)
SELECT gpus, n, round(minutes, 6) AS minutes, round(n / minutes, 6) AS throughput,
  round(n / minutes / thr, 6) AS speedup, round(n / minutes / thr / gpus, 6) AS efficiency FROM r, b""")
def scaling_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    runs = log.groupBy(F.expr("shiftleft(1L, cast(user_id % 4 AS int))").alias("gpus")).agg(
        F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 60000000.0).alias("minutes"))
    out = A.scaling(runs)
    return out.select("gpus", "n", *[r6(c, c) for c in ("minutes", "throughput", "speedup", "efficiency")])


KINDS = ("click", "error", "purchase", "signup", "view")


@query("round_pivot", f"""WITH {LOG}
SELECT (k % 3 + 1)::INTEGER AS round,
  {", ".join(f"round(avg(value) FILTER (kind = '{c}'), 6) AS {c}" for c in KINDS)},
  round(avg(value), 6) AS total FROM log GROUP BY ROLLUP (k % 3 + 1)""")
def round_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).select((F.col("k") % 3 + 1).alias("round"), "kind", "value")
    out = A.breakdown(log, "round", "kind", KINDS, "value")
    return out.select("round", *[r6(c, c) for c in (*KINDS, "total")])


@query("failed_targets", f"""WITH {LOG}
SELECT user_id AS target, count(*) AS n_failed, arg_min(message, t) AS first_error
FROM log WHERE status = 'error' GROUP BY user_id""")
def failed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failed_targets(request_log(spark, sf_dir), "user_id", "t").withColumnRenamed("user_id", "target")


@query("attempt_fold", """WITH f AS (
  SELECT l_orderkey, max({'a': l_linenumber, 'o': l_returnflag, 'q': l_quantity}) AS last, count(*) AS n,
    sum(0.5::DOUBLE * pow(2, l_linenumber - 1)) AS wait FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS batch_id, last.o AS outcome, last.q AS quantity, n - 1 AS retries,
  wait - 0.5::DOUBLE * pow(2, last.a - 1) AS backoff FROM f""")
def attempt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("attempt"),
        F.col("l_returnflag").alias("outcome"), F.col("l_quantity").alias("quantity"))
    return A.fold_attempts(li, "batch_id", "attempt", ["outcome", "quantity"])
