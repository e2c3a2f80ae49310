"""Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqflow.functions import sequences as S
from seqflow.operators.ordered import join_on
from seqflow.operators.packing import pack_with_state
from seqflow.session import scratch_path
from seqflow.streaming.drain import drain_append, file_stream, run_batches


def rates(events: DataFrame, ts: str, by: Sequence[str], tokens: str, interval: str, delay: str) -> DataFrame:
    """Requests and tokens per fixed interval, with rates per second."""
    w = F.window(ts, interval)
    agg = events.withWatermark(ts, delay).groupBy(*by, w.alias("_w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))
    sec = F.unix_timestamp(F.col("_w.end")) - F.unix_timestamp(F.col("_w.start"))
    return agg.select(*by, F.col("_w.start").alias("start"), "requests", "tokens",
                      (F.col("requests") / sec).alias("req_per_sec"), (F.col("tokens") / sec).alias("tok_per_sec"))


def telemetry_windows(samples: DataFrame, ts: str, by: Sequence[str], value: str, interval: str,
                      delay: str) -> DataFrame:
    """Samples per host and checkpoint interval: count, mean, maximum."""
    agg = samples.withWatermark(ts, delay).groupBy(*by, F.window(ts, interval).alias("_w")).agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    return agg.select(*by, F.col("_w.start").alias("start"), "num_samples", "avg", "max")


def device_counts(events: DataFrame, by: Sequence[str], failed: Column) -> DataFrame:
    """Running counters per device."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors"),
                                   F.count_if(~failed).alias("processed"))


def first_seen(events: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """The first completion of a request passes; repeats within the delay do not."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def timeouts(requests: DataFrame, completions: DataFrame, bound: str, delay: str) -> DataFrame:
    """Each request with its completion within ``bound``, or a time-out.

    Both sides are ``(request_id, at)``. Each carries a watermark, so the state
    holds about ``bound + delay`` of traffic.
    """
    r = requests.select(F.col("request_id"), F.col("at").alias("asked")).withWatermark("asked", delay)
    c = completions.select(F.col("request_id").alias("done_id"), F.col("at").alias("done")).withWatermark("done", delay)
    within = F.expr(f"request_id = done_id AND done >= asked AND done <= asked + INTERVAL {bound}")
    joined = r.join(c, within, "leftOuter")
    return joined.select("request_id", "asked", "done", F.col("done").isNull().alias("timed_out"))


def drain_timeouts(requests: DataFrame, completions: DataFrame, bound: str, delay: str,
                   end_marker: DataFrame) -> DataFrame:
    """Drain ``timeouts`` to the last request.

    An outer row waits for the watermark to pass, so the open tail needs an end
    marker: one late row that is released into both inputs after the first
    drain, when a second drain of the same query picks it up.
    """
    spark = requests.sparkSession
    inbox = scratch_path(spark, "end-marker")
    end_marker.limit(0).write.parquet(inbox)
    marker = file_stream(spark, inbox, end_marker.schema)
    cols = ["request_id", "at"]
    left, right = (s.select(*cols).unionByName(marker.select(*cols)) for s in (requests, completions))
    query = timeouts(left, right, bound, delay)
    checkpoint, out = scratch_path(spark, "stream-ckpt"), scratch_path(spark, "stream-out")
    drain_append(query, checkpoint, out)
    end_marker.write.mode("append").parquet(inbox)
    rows = drain_append(query, checkpoint, out)
    return rows.join(end_marker.select("request_id"), "request_id", "left_anti")


def windowed_counts(events: DataFrame, ts: str, interval: str, delay: str) -> DataFrame:
    """Rows per window; rows that arrive after their window closed are dropped."""
    w = F.window(ts, interval)
    agg = events.withWatermark(ts, delay).groupBy(w.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("_w.start").alias("start"), "n")


def embed_stream(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Clean, drop empty ones, embed: the stateless part of an embedding service."""
    seqs = docs.where(S.has_residue(text_col)).select(id_col, S.clean(text_col).alias("seq"))
    return seqs.select(id_col, F.length("seq").alias("n"), S.composition("seq").alias("embedding"))


def pack_stream(seqs: DataFrame, order: str, size: str, budget: int, by: Sequence[str], **packing) -> DataFrame:
    """Token-budget batches of an unbounded feed.

    Each micro-batch is packed by the batch operator, which also splits busy
    lanes, starting from the batches its predecessor left open. State is one
    row per lane, stored under the micro-batch id, so a replay starts from the
    same state.
    """
    spark = seqs.sparkSession
    out, state = scratch_path(spark, "packed"), scratch_path(spark, "pack-state")
    fields = {f.name: f.dataType.simpleString() for f in seqs.schema}
    lanes = ", ".join(f"`{c}` {fields[c]}" for c in by)

    def step(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        df = df.persist()  # ids and lengths only; several passes read them
        carry = None
        if batch_id:
            carry = session.read.parquet(f"{state}/after={batch_id - 1}")
        packed, after = pack_with_state(df, order, size, budget, by, carry, **packing)
        packed.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if carry is not None:  # lanes without new rows keep their open batch
            idle = join_on(carry, df.select(*by).distinct(), list(by), "left_anti")
            after = after.unionByName(idle)
        after.write.mode("overwrite").parquet(f"{state}/after={batch_id}")
        df.unpersist()

    run_batches(seqs.select(*by, order, size), step)
    schema = f"{lanes}, `{order}` bigint, `{size}` bigint, batch_no bigint, batch_id int"
    return spark.read.schema(schema).parquet(out).drop("batch_id")
