"""Run accounting: rates, load, outcomes, retries, scaling, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqflow.operators.ordered import CHUNK, chunked, join_on, ordered_scan, prefix_sums

BACKOFF_BASE = 0.5


def interval_rates(log: DataFrame, ts: str = "ts", requests: str = "requests", tokens: str = "tokens",
                   by: Sequence[str] = ("run",), t_start: Column | None = None, **chunking) -> DataFrame:
    """Deltas and rates per second between lines of cumulative counters.

    Counters start at zero. Lines without progress are skipped and do not move
    the clock, so the next ``dt`` spans them. The first ``dt`` counts from
    ``t_start`` (a column), or is null.
    """
    by = list(by)
    keys = [*by, CHUNK]
    here = W.partitionBy(*keys).orderBy(ts)
    chunks = W.partitionBy(*by).orderBy(CHUNK)

    def deltas(prev: Column, now: Column) -> tuple[Column, Column]:
        return tuple(now[c] - F.coalesce(prev[c], F.lit(0)) for c in ("r", "t"))

    def moved(prev: Column, now: Column) -> Column:
        r, t = deltas(prev, now)
        return (r != 0) | (t != 0)

    now = F.struct(F.col(requests).alias("r"), F.col(tokens).alias("t"))
    local = chunked(log, ts, **chunking).withColumn("_now", now)
    local = local.select("*", F.row_number().over(here).alias("_rn"), F.lag("_now").over(here).alias("_prev"))
    # Whether a chunk's first line moved depends on the chunk ahead; of the others it is known here.
    clock = F.when((F.col("_rn") > 1) & moved(F.col("_prev"), F.col("_now")), F.col(ts))
    local = local.withColumn("_inside", F.last(clock, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1)))
    edges = local.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(ts).alias("ts"), F.col("_now").alias("now")), "_rn").alias("_first"),
        F.max_by("_now", "_rn").alias("_last"), F.max(clock).alias("_end"))
    edges = edges.withColumn("_carry", F.lag("_last").over(chunks))
    edges = edges.withColumn("_lead", F.when(moved(F.col("_carry"), F.col("_first.now")), F.col("_first.ts")))
    upto = F.coalesce("_end", "_lead")
    since = F.last(upto, ignorenulls=True).over(chunks.rowsBetween(W.unboundedPreceding, -1))
    edges = edges.select(*keys, "_carry", "_lead", since.alias("_since"))
    lines = join_on(local, edges, keys)
    first = F.col("_rn") == 1
    prev = F.when(first, F.col("_carry")).otherwise(F.col("_prev"))
    d_requests, d_tokens = deltas(prev, F.col("_now"))
    last_move = F.when(first, F.col("_since")).otherwise(F.coalesce("_inside", "_lead", "_since"))
    if t_start is not None:
        last_move = F.coalesce(last_move, t_start)
    out = lines.select(*log.columns, d_requests.alias("d_requests"), d_tokens.alias("d_tokens"),
                       (F.col(ts) - last_move).cast("double").alias("dt"))
    out = out.where(((F.col("d_requests") != 0) | (F.col("d_tokens") != 0)) & (F.col("dt").isNull() | (F.col("dt") > 0)))
    return (out.withColumn("req_per_sec", F.col("d_requests") / F.col("dt"))
            .withColumn("tok_per_sec", F.col("d_tokens") / F.col("dt")))


def in_flight(requests: DataFrame, start: str, end: str, tokens: str, by: Sequence[str] = (),
              **chunking) -> DataFrame:
    """Open requests and queued tokens after each change, from one log.

    One scan gives both edges; edges at the same instant merge before ordering.
    """
    by = list(by)
    edge = F.inline(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("n"), F.col(tokens).alias("tok")),
        F.struct(F.col(end).alias("t"), F.lit(-1).alias("n"), (-F.col(tokens)).alias("tok"))))
    edges = requests.select(*by, edge).groupBy(*by, "t").agg(
        F.sum("n").cast("bigint").alias("dn"), F.sum("tok").cast("bigint").alias("dtok"))
    run = prefix_sums(edges, "t", {"_n": F.col("dn"), "_tok": F.col("dtok")}, by, **chunking)
    return run.select(*by, "t", (F.col("_n") + F.col("dn")).alias("in_flight"),
                      (F.col("_tok") + F.col("dtok")).alias("queue_tokens"))


def load_snapshot(requests: DataFrame, at: Column, start: str, end: str, by: Sequence[str]) -> DataFrame:
    """Busy, waiting and processed requests at one instant."""
    s, e = F.col(start), F.col(end)
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((s <= at) & (e > at)).alias("busy"),
        F.count_if(s > at).alias("waiting"),
        F.count_if(e <= at).alias("processed"))


def first_completions(done: DataFrame, ts: str, cols: Sequence[str], key: str = "request_id") -> DataFrame:
    """The earliest completion of each request; later ones are ignored, equal times go by the other columns."""
    first = F.min(F.when(F.col(ts).isNotNull(), F.struct(ts, *cols))).alias("_first")
    return done.groupBy(key).agg(first).select(key, F.col(f"_first.{ts}").alias(ts),
                                               *[F.col(f"_first.{c}").alias(c) for c in cols])


def match_requests(requests: DataFrame, done: DataFrame, ts: str, cols: Sequence[str],
                   key: str = "request_id") -> DataFrame:
    """Each request with its first completion, or nulls."""
    return requests.join(first_completions(done, ts, cols, key), key, "left")


def timed_out(latency: Column, request_timeout: Column, inference_timeout: Column | float) -> Column:
    """True if the latency exceeds the tighter of the two bounds."""
    other = F.lit(inference_timeout) if isinstance(inference_timeout, (int, float)) else inference_timeout
    return latency > F.least(request_timeout, other)


def outcome_rollup(results: DataFrame, by: Sequence[str] = (), failed: Column | None = None,
                   retries: str = "retries") -> DataFrame:
    """submitted / successful / failed / retries."""
    bad = F.col("status") == "error" if failed is None else failed
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if(~bad).alias("successful"),
        F.count_if(bad).alias("failed"), F.sum(retries).cast("bigint").alias("retries"))


def error_messages(results: DataFrame, by: Sequence[str], message: str = "message") -> DataFrame:
    """Each distinct message with its count, as rows: a list would be unbounded."""
    return (results.where("status = 'error'").groupBy(*by, message)
            .agg(F.count(F.lit(1)).alias("n")))


def failed_targets(results: DataFrame, target: str, order: str, message: str = "message") -> DataFrame:
    """Targets with an error, their error count and first message."""
    bad = results.where("status = 'error'")
    return bad.groupBy(target).agg(F.count(F.lit(1)).alias("n_failed"),
                                   F.min(F.struct(order, message))[message].alias("first_error"))


def fold_attempts(attempts: DataFrame, key: str, attempt: str, cols: Sequence[str]) -> DataFrame:
    """One outcome per batch: last attempt, retry count and total back-off.

    Attempt n (from 1) is followed by a wait of ``0.5 * 2^(n-1)`` unless it is
    the last one. Of equal attempt numbers the greatest ``cols`` counts.
    """
    wait = BACKOFF_BASE * F.pow(F.lit(2.0), F.col(attempt) - 1)
    folded = attempts.groupBy(key).agg(
        F.max(F.struct(attempt, *cols)).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.sum(wait).alias("_wait"))
    last_wait = BACKOFF_BASE * F.pow(F.lit(2.0), F.col(f"_last.{attempt}") - 1)
    return folded.select(key, *[F.col(f"_last.{c}") for c in cols], (F.col("_n") - 1).alias("retries"),
                         (F.col("_wait") - last_wait).alias("backoff"))


def step_times(log: DataFrame, ts: str, by: Sequence[str], **chunking) -> DataFrame:
    """Time since the previous step and since the first one."""
    out = ordered_scan(log, ts, by, lags={"_prev": ts}, firsts={"_first": ts}, **chunking)
    return (out.withColumn("step", F.col(ts) - F.coalesce("_prev", "_first"))
            .withColumn("total", F.col(ts) - F.col("_first")).drop("_prev", "_first"))


def telemetry_rollup(samples: DataFrame, by: Sequence[str], ts: str = "ts", bucket: str = "1 hour") -> DataFrame:
    """avg / max / min / count of each gauge per time bucket."""
    return (samples.groupBy(*by, F.window(ts, bucket).alias("_w"))
            .agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"),
                 F.count(F.lit(1)).alias("n"))
            .select(*by, F.col("_w.start").alias("bucket"), "avg", "max", "min", "n"))


def scaling(runs: DataFrame, size: str = "gpus", work: str = "n", minutes: str = "minutes") -> DataFrame:
    """Throughput, speed-up and efficiency against the smallest configuration."""
    thr = runs.withColumn("throughput", F.col(work) / F.col(minutes))
    base = thr.agg(F.min_by(F.struct(F.col(size).alias("s"), F.col("throughput").alias("t")), size).alias("b"))
    out = thr.withColumn("_b", base.scalar())
    out = out.withColumn("speedup", F.col("throughput") / F.col("_b.t"))
    return out.withColumn("efficiency", F.col("speedup") / (F.col(size) / F.col("_b.s"))).drop("_b")


def breakdown(rows: DataFrame, row: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Mean of ``measure`` per row and column value, with a total line (null row)."""
    cells = [F.avg(F.when(F.col(column) == v, F.col(measure))).alias(v) for v in values]
    return rows.rollup(row).agg(*cells, F.avg(measure).alias("total"))
