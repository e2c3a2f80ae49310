"""Operators with keyed state of their own: values and timers in the RocksDB state store.

State lives in the query's checkpoint. A caller who names the checkpoint and the
output folder can stop after any micro-batch and go on later, or elsewhere, from
exactly that state; the file sink drops what a replayed batch had written before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from seqflow.operators.packing import _chain_starts, first_overflow
from seqflow.streaming.drain import drain_append

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 1024  # of keys that are held together


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed processors need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _milli(micros):
    """The first millisecond that is not ahead of ``micros``, a number or a column; watermarks count milliseconds."""
    return -(-micros // 1000)


_ORDER = ["us", "has", "value"]


def _earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """Each key's smallest (time, value), null first; a key that was passed on stays as it was."""
    ranked = rows.sort_values(["sent", *_ORDER], ascending=[False, True, True, True], kind="stable")
    return ranked.drop_duplicates(["known", "key"])


class _Earliest(StatefulProcessor):
    """Hold the smallest (time, value) of every key of a bucket and pass it on once nothing earlier can come.

    A bucket's keys are one value of the state store with one timer, at the first time that any of them is
    due, so a micro-batch costs a few calls for each bucket, however many keys there are.
    """

    def __init__(self, remember_us: int):
        self.remember_us = remember_us

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary, due bigint")

    def _due(self, rows: pd.DataFrame) -> pd.Series:
        """The first millisecond at which a key is to be passed on, or to be forgotten."""
        return _milli(rows["us"] + rows["sent"] * self.remember_us)

    def _store(self, rows: pd.DataFrame, timer: int | None) -> None:
        """Keep ``rows``; ``timer`` is the one that is set."""
        due = int(self._due(rows).min()) if len(rows) else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.held.clear()
            return
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), due))

    def _read(self) -> tuple[pd.DataFrame | None, int | None]:
        held = self.held.get()
        if held is None:
            return None, None
        return pa.ipc.open_stream(bytes(held[0])).read_pandas(), held[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        best, came, n = [], [], 0
        if held is not None:  # what is to be forgotten goes first, as rows come ahead of timers
            best.append(held[~held["sent"] | (self._due(held) > timerValues.getCurrentWatermarkInMs())])
        for part in rows:
            came.append(part[["known", "key", *_ORDER]].assign(sent=False))
            n += len(part)
            if n > 2 * sum(map(len, best)):  # a key with many rows doesn't gather them
                best, came, n = [_earliest(pd.concat([*best, *came]))], [], 0
        self._store(_earliest(pd.concat([*best, *came])), timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        ready = ~held["sent"] & (self._due(held) <= now)
        out = held[ready].drop(columns="sent")
        held["sent"] |= ready
        self._store(held[self._due(held) > now], None)  # the timer that has gone off is gone
        if len(out):
            yield out

    def close(self) -> None:
        pass


def first_completions(events: DataFrame, key: str, ts: str, value: str, delay: str, remember_seconds: int = 86_400,
                      ts_name: str = "first_at", buckets: int = BUCKETS) -> DataFrame:
    """A stream of ``key, first_at, value``: each key's earliest row by time, whatever the order of arrival.

    A key is reported when the watermark reaches its smallest time, since no earlier row is accepted
    from then on. Its later rows are swallowed for ``remember_seconds`` more; then the state is dropped
    and the key may start again. Of equal times the smallest value counts, null first. Rows without a
    time are left out; a null key is a key like any other. ``key`` is a bigint or a string.

    State is kept by ``buckets`` of keys, each of which must fit a task. Their number belongs to the
    checkpoint and stays as it was at the first run.
    """
    kind = dict(events.dtypes)[key]
    zero = F.lit("" if kind == "string" else 0).cast(kind)
    text = F.col(value).cast("string")
    # Nulls travel as flags: pandas would make a column of numbers with nulls one of doubles.
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(ts).alias("at"),
        F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key), zero).alias("key"), F.unix_micros(ts).alias("us"),
        text.isNotNull().alias("has"), F.coalesce(text, F.lit("")).alias("value"))
    first = rows.groupBy("bucket").transformWithStateInPandas(
        _Earliest(remember_seconds * 1_000_000), f"known boolean, key {kind}, us bigint, has boolean, value string",
        "Append", "EventTime")
    return first.select(F.when(F.col("known"), F.col("key")).alias(key), F.timestamp_micros("us").alias(ts_name),
                        F.when(F.col("has"), F.col("value")).alias(value))


class _OpenBatch(StatefulProcessor):
    """One lane's open batch: its fill, its number and, with a wait, the time of its last row and a timer."""

    def __init__(self, lanes: Sequence[str], budget: int, wait_us: int | None):
        self.lanes, self.budget, self.wait_us = list(lanes), budget, wait_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "used bigint, batch_no bigint, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows))
        t = t.sort_values("ord", kind="stable")
        used, number, last = self.open.get() or (0, 0, None)
        sizes = t["size"].to_numpy(np.int64)
        numbers = np.full(len(t), -1, np.int64)
        breaks = [0, len(t)]
        if self.wait_us is not None:
            us = t["us"].to_numpy(np.int64)
            if last is not None:
                self.handle.deleteTimer(_milli(last + self.wait_us))
                if us[0] - last > self.wait_us:
                    used = self.budget + 1
            breaks = [0, *(np.flatnonzero(np.diff(us) > self.wait_us) + 1).tolist(), len(t)]
            last = int(us[-1])
            self.handle.registerTimer(_milli(last + self.wait_us))
        for a, e in zip(breaks, breaks[1:]):
            if a:
                used = self.budget + 1  # a gap of more than the wait has closed the batch
            fits = np.flatnonzero(sizes[a:e] <= self.budget) + a
            if not len(fits):
                continue
            prefix = np.concatenate([[0], np.cumsum(sizes[fits])])
            opens = _chain_starts(prefix, max(0, first_overflow(prefix, used, self.budget)), self.budget)
            flags = np.zeros(len(fits), np.int64)
            flags[opens] = 1
            numbers[fits] = number + np.cumsum(flags)
            number += len(opens)
            used = int(prefix[-1] - prefix[opens[-1]]) if opens else used + int(prefix[-1])
        self.open.update((used, number, last))
        out = t[[*self.lanes, "ord", "size"]].copy()
        out["batch_no"] = pd.array(numbers, dtype="Int64")
        out.loc[numbers < 0, "batch_no"] = pd.NA
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, number, _ = self.open.get()
        self.open.update((self.budget + 1, number, None))  # whatever comes next opens a batch
        yield from ()

    def close(self) -> None:
        pass


def pack_keyed(seqs: DataFrame, order: str, size: str, budget: int, by: Sequence[str], checkpoint: str, path: str,
               ts: str | None = None, delay: str = "0 seconds", wait_seconds: int | None = None) -> DataFrame:
    """Drain a feed into token-budget batches whose open ones wait in the state store.

    Returns the stored ``by..., order, size, batch_no`` of this and all earlier calls with the same
    ``checkpoint`` and ``path``; a further call goes on with the batches left open. Rows come in
    order between micro-batches and are sorted within one, so a micro-batch of a lane must fit a task
    (``maxFilesPerTrigger``). A row above the budget is kept with a null batch number. With
    ``wait_seconds``, a batch also closes once the watermark of ``ts``, or the lane's next row, is further
    than that behind its last row.
    """
    spark = seqs.sparkSession
    timed = wait_seconds is not None
    if timed and ts is None:
        raise ValueError("closing by time needs a time column")
    # Names of their own: Spark hands columns over by names that must be plain identifiers.
    lanes = [f"lane{i}" for i in range(max(1, len(by)))]
    keys = [F.col(c).alias(n) for n, c in zip(lanes, by)] or [F.lit(0).alias(lanes[0])]
    rows = seqs.select(*keys, F.col(order).cast("bigint").alias("ord"), F.col(size).cast("bigint").alias("size"),
                       *([F.col(ts).alias("at"), F.unix_micros(ts).alias("us")] if timed else []))
    if timed:
        rows = rows.withWatermark("at", delay)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*lanes, "ord", "size"]) + ", batch_no bigint"
    packer = _OpenBatch(lanes, budget, wait_seconds * 1_000_000 if timed else None)
    packed = rows.groupBy(*lanes).transformWithStateInPandas(packer, schema, "Append", "EventTime" if timed else "None")
    named = packed.select(*[F.col(n).alias(c) for n, c in zip(lanes, by)], F.col("ord").alias(order), F.col("size").alias(size), "batch_no")
    with rocksdb(spark):
        return drain_append(named, checkpoint, path)
