"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a source with few splits; a large source stays as it is.

    A file with a single row group is one task however it is split. Ahead of
    costly per-row work it pays to deal its rows out once, by a hash of ``key``
    so that a retried task sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, key)
