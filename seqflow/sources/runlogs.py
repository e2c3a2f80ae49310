"""Run metrics, client outcomes and telemetry checkpoints as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.session import scratch_path

# The JSON shapes of the three kinds of run log.
METRICS_SCHEMA = (
    "run string, requests bigint, queue_tokens bigint, total_tokens bigint, errors bigint, t_start double, "
    "t_last double, last_requests bigint, last_tokens bigint, timeseries array<struct<timestamp:double, "
    "dt:double, requests:bigint, tokens:bigint, req_per_sec:double, tok_per_sec:double, total_tokens:bigint, "
    "queue_tokens:bigint, work_queue_depth:bigint, gpu_stats:map<string,struct<processed:bigint>>>>, "
    "gpu_stats map<string,struct<processed:bigint>>")
CLIENT_SCHEMA = ("run string, submitted bigint, successful bigint, failed bigint, error_msgs array<string>, "
                 "retries bigint")
TELEMETRY_SCHEMA = (
    "checkpoint_metadata struct<hostname:string, timestamp:bigint, collection_rate:double, "
    "metric_prefix:string, checkpoint_id:bigint, num_samples:bigint>, "
    "metrics array<struct<timestamp:bigint, hostname:string, metrics:map<string,double>>>")


def _read(spark: SparkSession, path, schema: str, multiline: bool) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", multiline).json(path)
    if "run" not in rows.columns:
        return rows
    # Recorded files have no such field: the folder and the number of the file say which run it was.
    file = F.regexp_replace(F.col("_metadata.file_path"), r"^.*/([^/]+)/[^/]*?(\d+)\.json$", "$1/$2")
    return rows.withColumn("run", F.coalesce("run", file))


def write_json(rows: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    path = path or scratch_path(rows.sparkSession, "json")
    rows.write.mode(mode).json(path)
    return path


def read_run_metrics(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """One row per run; ``multiline`` for one indented object per file."""
    return _read(spark, path, METRICS_SCHEMA, multiline)


def metric_intervals(metrics: DataFrame) -> DataFrame:
    """The time series as rows."""
    return metrics.select("run", F.inline("timeseries"))


def device_totals(metrics: DataFrame) -> DataFrame:
    """Processed requests per device as rows."""
    return metrics.select("run", F.explode("gpu_stats").alias("device", "_s")).select(
        "run", "device", F.col("_s.processed").alias("processed"))


def read_client_outcomes(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    return _read(spark, path, CLIENT_SCHEMA, multiline)


def read_telemetry(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    return _read(spark, path, TELEMETRY_SCHEMA, multiline)


def stream_telemetry(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Checkpoint files as a stream, at most that many to a micro-batch."""
    reader = spark.readStream.schema(TELEMETRY_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def telemetry_samples(checkpoints: DataFrame) -> DataFrame:
    """One row per host, instant and gauge; GPU gauges get their GPU number."""
    samples = checkpoints.select(F.inline("metrics"))
    gauges = samples.select("timestamp", "hostname", F.explode("metrics").alias("key", "value"))
    gpu = F.regexp_extract("key", "^gpu_(\\d+)_", 1)
    return gauges.select(
        F.col("hostname").alias("host"), "timestamp", F.timestamp_seconds("timestamp").alias("ts"),
        F.when(gpu != "", gpu.cast("int")).alias("gpu"),
        F.regexp_replace("key", "^gpu_\\d+_", "").alias("gauge"), "value")
