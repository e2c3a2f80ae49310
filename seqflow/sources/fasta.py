"""FASTA files as ``(seq_id, description, seq)`` rows, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqflow.operators.ordered import join_on, prefix_sums
from seqflow.session import scratch_path


def read_fasta(spark: SparkSession, paths: str | Sequence[str], keep_empty: bool = False,
               with_order: bool = False) -> DataFrame:
    """One row per record; sequence lines are joined and blanks removed.

    The record separator is a line break followed by ``>``, so large files
    still split across tasks. A file starts with ``>``. Partition columns of
    the path (such as ``round=3``) are kept. ``with_order`` adds ``ord``, the
    position over all files by path and offset.
    """
    raw = spark.read.option("lineSep", "\n>").text(list(paths) if not isinstance(paths, str) else paths)
    extra = [c for c in raw.columns if c != "value"]
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
          F.monotonically_increasing_id().alias("_m")] if with_order else []
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = raw.select(*extra, F.split(text, "\n", 2).alias("_p"), *at)
    head = F.trim(F.col("_p")[0])
    body = F.coalesce(F.regexp_replace(F.get("_p", F.lit(1)), "\\s", ""), F.lit(""))
    rows = rows.select(*extra, F.split(head, "\\s+", 2)[0].alias("seq_id"),
                       head.alias("description"), body.alias("seq"), *[c for c in rows.columns if c in ("_f", "_b", "_m")])
    if with_order:
        # One row per file block carries the offset, by a distributed scan; the records stay in place.
        blocks = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
        blocks = prefix_sums(blocks.withColumn("_at", F.struct("_f", "_b")), "_at", {"_before": F.col("_n")}).drop("_n", "_at")
        rows = (join_on(rows, blocks, ["_f", "_b"])
                .withColumn("ord", F.col("_before") + F.col("_m") - F.col("_m0"))
                .drop("_f", "_b", "_m", "_m0", "_before"))
    return rows if keep_empty else rows.where(F.length("seq") > 0)


def write_fasta(seqs: DataFrame, seq_id: Column | str, seq_col: str = "seq", path: str | None = None,
                wrap: int | None = None, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write ``>id`` and the sequence, wrapped to ``wrap`` letters if given."""
    path = path or scratch_path(seqs.sparkSession, "fasta")
    name = F.col(seq_id) if isinstance(seq_id, str) else seq_id
    body = F.col(seq_col)
    if wrap:
        body = F.regexp_replace(body, f"(.{{{wrap}}})(?=.)", "$1\n")
    out = seqs.select(*partition_by, F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), body).alias("value"))
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)
    return path


def write_labels(rows: DataFrame, col: str, path: str | None = None, mode: str = "overwrite") -> str:
    """One label per line."""
    path = path or scratch_path(rows.sparkSession, "labels")
    rows.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)
    return path


def read_labels(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias(name))
