"""Streams against the batch operators."""

import random

from pyspark.sql import functions as F

from seqflow.operators.packing import pack
from seqflow.session import scratch_path
from seqflow.streaming import jobs as J
from seqflow.streaming.drain import drain_append, drain_update, dropped_rows, file_stream


def stage(df, parts):
    """Write ``df`` as files that arrive one after the other."""
    path = scratch_path(df.sparkSession, "stage")
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return path


def test_pack_stream_equals_batch(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"l{rng.randrange(3)}", i, rng.randint(1, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "lane string, id long, n long")
    path = stage(df, ["id < 100", "id >= 100 AND id < 250", "id >= 250"])
    stream = file_stream(spark, path, df.schema, max_files_per_trigger=1)
    got = J.pack_stream(stream, "id", "n", 100, ["lane"], chunk_rows=50, max_chunks=8)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in pack(df, "id", "n", 100, ["lane"]).collect()}


def events(spark):
    rows = [(i, 1_700_000_000 + i * 60, i % 3, float(i % 7)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, sec long, dev long, value double").withColumn("ts", F.timestamp_seconds("sec"))


def test_windows_over_many_batches(spark):
    df = events(spark)
    path = stage(df, ["id < 90", "id >= 90 AND id < 95", "id >= 95"])
    stream = file_stream(spark, path, df.schema, max_files_per_trigger=1)
    got = drain_update(J.rates(stream, "ts", ["dev"], "sec", "10 minutes", "1 hour"), ["dev", "start"])
    want = df.groupBy("dev", F.window("ts", "10 minutes").start.alias("start")).agg(F.count("*").alias("requests"), F.sum("sec").alias("tokens"))
    cols = ["dev", "start", "requests", "tokens"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


def test_counts_and_first_seen(spark):
    df = events(spark)
    path = stage(df, ["id < 150", "id >= 150"])
    stream = file_stream(spark, path, df.schema, max_files_per_trigger=1)
    got = {r.dev: (r.requests, r.errors) for r in drain_update(J.device_counts(stream, ["dev"], F.col("value") == 0), ["dev"]).collect()}
    assert got == {d: (100, sum(1 for i in range(300) if i % 3 == d and i % 7 == 0)) for d in range(3)}
    firsts = drain_append(J.first_seen(file_stream(spark, path, df.schema, max_files_per_trigger=1).select("dev", "ts"), "ts", "dev", "30 days"))
    assert sorted(r.dev for r in firsts.collect()) == [0, 1, 2]


def test_timeouts_include_the_tail(spark):
    asked = events(spark).select(F.col("id").alias("request_id"), F.col("ts").alias("at"))
    done = asked.where("request_id % 2 = 0").withColumn("at", F.col("at") + F.expr("INTERVAL 5 MINUTES"))
    late = asked.where("request_id % 4 = 1").withColumn("at", F.col("at") + F.expr("INTERVAL 2 HOURS"))
    schema = asked.schema
    a, d = stage(asked, ["true"]), stage(done.unionByName(late), ["true"])
    marker = asked.orderBy(F.desc("at")).limit(1).select(F.lit(-1).cast("long").alias("request_id"), (F.col("at") + F.expr("INTERVAL 9 DAYS")).alias("at"))
    rows = J.drain_timeouts(file_stream(spark, a, schema), file_stream(spark, d, schema), "30 MINUTES", "10 minutes", marker)
    assert {r.request_id: r.timed_out for r in rows.collect()} == {i: i % 2 == 1 for i in range(300)}


def test_late_rows_are_dropped(spark):
    df = events(spark)
    path = scratch_path(spark, "waves")
    df.select("ts").limit(0).write.parquet(path)

    def release(cond):
        return lambda: df.where(cond).select("ts").write.mode("append").parquet(path)

    counts = J.windowed_counts(file_stream(spark, path, "ts timestamp"), "ts", "10 minutes", "30 minutes")
    reports = []
    got = drain_update(counts, ["start"], [release("id >= 100 AND id < 200"), release("id < 100 OR id >= 200")], reports)
    assert dropped_rows(reports) > 0
    total = got.agg(F.sum("n")).first()[0]
    assert 200 <= total < 300
