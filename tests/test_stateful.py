"""Keyed stream state: earliest rows, batches that resume, the ledger of micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqflow.operators.packing import pack
from seqflow.session import scratch_path
from seqflow.streaming import jobs as J
from seqflow.streaming.drain import Ledger, counted, drain_append, drain_update, file_stream
from seqflow.streaming.stateful import first_completions, pack_keyed, rocksdb

DAY = datetime(2024, 5, 1)
EVENT = "request string, ts timestamp, status string"


def feed(spark, inbox, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)


def test_earliest_row_whatever_the_order(spark):
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("in", "ck", "out"))
    at = lambda h: DAY + timedelta(hours=h)
    waves = [[("a", at(5), "late"), ("b", at(2), "b2"), (None, at(1), "n"), ("x", None, "no time")],
             [("a", at(4), "early"), ("a", at(4), "also"), ("b", at(3), "b3"), ("c", at(2), None), ("c", at(2), "z")],
             [("end", at(40), "-")],           # the watermark passes all of the above
             [("a", at(41), "again"), ("d", at(41), "d")],
             [("end", at(100), "-")]]
    feed(spark, inbox, [], EVENT)
    seen = []
    with rocksdb(spark):
        for w in waves:
            feed(spark, inbox, w, EVENT)
            stream = first_completions(file_stream(spark, inbox, EVENT), "request", "ts", "status", "6 hours", remember_seconds=10 * 3600)
            rows = drain_append(stream, checkpoint, out)
            seen.append({(r.request, r.first_at, r.status) for r in rows.collect()})
    first = {("a", at(4), "also"), ("b", at(2), "b2"), ("c", at(2), None), (None, at(1), "n")}
    assert seen[0] == seen[1] == set() and first <= seen[2]
    # "a" came again long after the ten hours for which repeats are swallowed.
    assert seen[4] - seen[2] >= {("a", at(41), "again"), ("d", at(41), "d")}


def test_keys_share_state_and_calls(spark):
    rng = random.Random(5)
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("in", "ck", "out"))
    schema = "id long, ts timestamp, kind string"
    rows = [(rng.choice([None, rng.randrange(8000) + (1 << 60)]) if i % 50 == 0 else i % 8000 + (1 << 60),
             DAY + timedelta(seconds=rng.randrange(3600)), rng.choice(["a", "b", None])) for i in range(24_000)]
    waves = [rows[:12_000], rows[12_000:], [(-1, DAY + timedelta(days=9), "end")]]
    feed(spark, inbox, [], schema)
    state = 0
    with rocksdb(spark):
        for w in waves:
            feed(spark, inbox, w, schema)
            first = first_completions(file_stream(spark, inbox, schema), "id", "ts", "kind", "6 hours")
            query = (first.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start(out))
            query.awaitTermination()
            state = max([state, *(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)])
    want = {}
    for k, t, v in rows:
        want[k] = min(want.get(k, (t, v is not None, v or "")), (t, v is not None, v or ""))
    got = [(r.id, (r.first_at, r.kind is not None, r.kind or "")) for r in spark.read.parquet(out).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert state <= 3 * 1024  # a value, a timer and the timer's order for a bucket; before, for each of 8000 keys


def test_batches_resume_from_the_checkpoint(spark):
    rng = random.Random(3)
    schema = "lane string, id long, n long"
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([1, 10, 40, 99, 100, 101])) for i in range(400)]
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("in", "ck", "out"))
    for k in range(0, 400, 100):
        feed(spark, inbox, rows[k:k + 100], schema)
        got = pack_keyed(file_stream(spark, inbox, schema), "id", "n", 100, ["lane"], checkpoint, out)
    want = pack(spark.createDataFrame(rows, schema), "id", "n", 100, ["lane"]).collect()
    assert {(r.lane, r.id, r.batch_no) for r in got.where("batch_no IS NOT NULL").collect()} == {(r.lane, r.id, r.batch_no) for r in want}
    assert {r.id for r in got.where("batch_no IS NULL").collect()} == {i for _, i, n in rows if n > 100}


def test_a_batch_closes_after_its_wait(spark):
    schema = "id long, n long, ts timestamp"
    inbox, checkpoint, out = (scratch_path(spark, n) for n in ("in", "ck", "out"))
    waves = [[(1, 10, DAY), (2, 10, DAY + timedelta(minutes=1))], [(3, 10, DAY + timedelta(minutes=2))],
             [(4, 10, DAY + timedelta(hours=3))], [(5, 10, DAY + timedelta(hours=3, minutes=1))]]
    for w in waves:
        feed(spark, inbox, w, schema)
        got = pack_keyed(file_stream(spark, inbox, schema), "id", "n", 100, [], checkpoint, out, ts="ts", wait_seconds=3600)
    numbers = {r.id: r.batch_no for r in got.collect()}
    assert numbers == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        pack_keyed(file_stream(spark, inbox, schema), "id", "n", 100, [], checkpoint, out, wait_seconds=1)


def test_ledger_counts_every_micro_batch(spark):
    inbox = scratch_path(spark, "in")
    schema = "ts timestamp"
    feed(spark, inbox, [], schema)
    waves = [[DAY + timedelta(hours=h) for h in (0, 1, 2, 2)], [DAY + timedelta(hours=30)], [DAY, DAY, DAY + timedelta(hours=31)]]
    put = [lambda w=w: feed(spark, inbox, [(t,) for t in w], schema) for w in waves]
    with Ledger(spark) as ledger:
        out = drain_update(J.windowed_counts(counted(file_stream(spark, inbox, schema), "rows"), "ts", "1 hour", "2 hours"), ["start"], put)
        kept = out.agg(F.sum("n")).first()[0]
    assert ledger.total("rows", "rows").first()[0] == 8 and kept == 6
    assert ledger.entries().select("batch").distinct().count() >= 3
