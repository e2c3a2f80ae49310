"""Reports per target and round: JSON evaluations, CSV records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqflow.session import scratch_path

_STATS = ("embedding struct<cosine_min:double,cosine_max:double,cosine_mean:double,"
          "l2_min:double,l2_max:double,l2_mean:double>")
EVALUATION_SCHEMA = (f"target string, round int, {_STATS}, "
                     "structure struct<min:double,max:double,mean:double>")


def write_evaluations(evals: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """``target, round, embedding{...}[, structure{...}]`` as JSON lines."""
    path = path or scratch_path(evals.sparkSession, "evaluations")
    evals.write.mode(mode).json(path)
    return path


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION_SCHEMA).json(path)


def write_parameters(params: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Run parameters as JSON, one row per run."""
    params.write.mode(mode).json(path)
    return path


def write_round_records(records: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """One row per generated sequence as CSV with a header, a folder for each ``goal`` and ``round``."""
    path = path or scratch_path(records.sparkSession, "records")
    records.write.mode(mode).partitionBy("goal", "round").option("header", True).csv(path)
    return path


def read_round_records(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
