"""Bounded runs of a stream: read what is there, then stop."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from seqflow.session import scratch_path

LEDGER = "query string, run string, batch bigint, name string, metrics map<string,bigint>, dropped bigint, input_rows bigint"


class Ledger(StreamingQueryListener):
    """Every micro-batch's counters, as Spark reports them, however many there are.

    A stream counts rows under a name with ``DataFrame.observe``; each micro-batch then gives one entry
    for each name. Use it as a context around the runs; ``entries()`` is the stored list behind it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "ledger")
        self._held: list[tuple] = []
        self._lock = threading.Lock()
        self._open: set[str] = set()
        self._quiet = threading.Condition(self._lock)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        metrics = {name: {k: int(v or 0) for k, v in row.asDict().items()} for name, row in p.observedMetrics.items()}
        with self._lock:
            for name, counts in (metrics or {"": {}}).items():
                self._held.append((str(p.id), str(p.runId), p.batchId, name, counts, late, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._quiet:
            self._open.discard(str(event.runId))
            self._quiet.notify_all()

    def __enter__(self) -> "Ledger":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self._quiet:  # reports arrive a little behind the stream
            self._quiet.wait_for(lambda: not self._open, timeout=60)
        self.spark.streams.removeListener(self)
        self._write()

    def _write(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def total(self, name: str, counter: str) -> DataFrame:
        """One row: the sum of a counter over all micro-batches; a batch reported twice counts once."""
        own = self.entries().where(F.col("name") == name).dropDuplicates(["query", "batch"])
        return own.agg(F.coalesce(F.sum(F.col("metrics")[counter]), F.lit(0)).alias(counter))


def counted(stream: DataFrame, name: str) -> DataFrame:
    """``stream``, whose rows a ``Ledger`` counts as ``rows`` under ``name``."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream over files that arrive at ``path`` (a folder or a glob)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a stream. The glob form accepts a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    return file_stream(spark, f"{path[:-1]}[t]", spark.read.parquet(path).schema)


def drain_append(stream: DataFrame, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run to the end of the available input in append mode; returns the stored rows."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_update(stream: DataFrame, keys: Sequence[str],
                 releases: Sequence[Callable[[], None]] = (), reports: list | None = None) -> DataFrame:
    """Run in update mode and keep the newest row of each key.

    Each of ``releases`` puts further files in place; the same query is then
    drained again, going on from its checkpoint. Progress reports are added to
    ``reports`` if given.

    Every micro-batch appends only the groups it changed, under its batch id,
    so a replayed batch overwrites itself and nothing waits for the watermark.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-updates")

    def save(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    checkpoint = scratch_path(spark, "stream-ckpt")
    for release in releases or [lambda: None]:
        release()
        progress = run_batches(stream, save, "update", checkpoint)
        if reports is not None:
            reports.extend(progress)
    rows = spark.read.parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*")


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], mode: str = "append",
                checkpoint: str | None = None) -> list:
    """Drain through ``foreachBatch``; returns the progress reports."""
    q = (stream.writeStream.foreachBatch(fn).outputMode(mode)
         .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def dropped_rows(reports: Sequence) -> int:
    """Rows (after partial aggregation) that stateful operators refused as too late."""
    return sum(op.numRowsDroppedByWatermark for p in reports for op in p.stateOperators)
