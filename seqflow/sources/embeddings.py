"""Embedding tables: wide CSV, and Parquet keyed by batch and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.session import scratch_path

BATCHES_PER_GROUP = 1000


def write_embedding_csv(rows: DataFrame, label: str, vec_col: str, dims: int, path: str | None = None,
                        mode: str = "overwrite") -> str:
    """``dims`` numeric columns, then the label."""
    path = path or scratch_path(rows.sparkSession, "embedding-csv")
    wide = rows.select(*[F.col(vec_col)[i].alias(f"d{i}") for i in range(dims)], F.col(label).alias("label"))
    wide.write.mode(mode).option("header", True).csv(path)
    return path


def read_embedding_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(label, embedding)``: the last column is the label, whatever its name."""
    raw = spark.read.option("header", True).csv(path)
    *dims, label = raw.columns
    return raw.select(F.col(f"`{label}`").alias("label"),
                      F.array(*[F.col(f"`{d}`").cast("double") for d in dims]).alias("embedding"))


def write_embeddings(rows: DataFrame, path: str | None = None, mode: str = "overwrite", folders: bool = True) -> str:
    """Per-sequence vectors keyed ``(lane, batch_no, seq_idx)``.

    Folders hold a thousand batches each, so the number of files follows the
    data. Writing to folders sorts the rows by folder; without ``folders`` each task writes its rows
    as they come, for rows much larger than what they were made from.
    """
    path = path or scratch_path(rows.sparkSession, "embeddings")
    if not folders:
        rows.write.mode(mode).parquet(path)
        return path
    (rows.withColumn("batch_group", F.floor(F.col("batch_no") / BATCHES_PER_GROUP))
     .write.mode(mode).partitionBy("batch_group").parquet(path))
    return path


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_group")
