"""From raw documents to token ids: the operators of ``seqflow.llm`` one after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.llm.decontaminate import contamination
from seqflow.llm.encode import encode
from seqflow.llm.exact_dedup import exact_dedup, text_class
from seqflow.llm.importance import SHARPNESS, resample
from seqflow.llm.ngram_join import ngram_components
from seqflow.llm.rows import keep_rows, with_row_key
from seqflow.llm.texts import free_name, same
from seqflow.session import materialize

#: Fitted models, random sampling and merges have no SQL form.
ORACLE_SQL = None
#: Near copies share this part of their word n-grams (Jaccard). op4 has values of its own, which its SQL fixes.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects, by importance resampling, go."""
    rows, key = with_row_key(docs)
    scored = resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=key, sharpness=SHARPNESS)
    return keep_rows(rows, scored.where("sampled").select(F.col("row").alias(key)), key).drop(key)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays; one row of those that repeat both."""
    of_text = free_name(docs, "__text")
    rows = docs.withColumn(of_text, text_class(F.col("text")))
    kept = exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias(of_text))
    return keep_rows(rows, kept, ["doc_id", of_text], one_per_id=True).drop(of_text)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shared n-grams, one row with the smallest id stays, with a null id only if all are null."""
    rows, key = with_row_key(docs)
    groups = ngram_components(rows, id_col=key, words=NEAR_WORDS, percent=NEAR_PERCENT).select(F.col("doc_id").alias(key), F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(key).alias("key"))
    first = same(rows.select(key, order.alias("order")), groups, [key], "inner").groupBy("component").agg(F.min("order").alias("order"))
    return keep_rows(rows, first.select(F.col("order.key").alias(key)), key).drop(key)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with too large a share of benchmark words go."""
    rows, key = with_row_key(docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return keep_rows(rows, found.where(~F.col("contaminated")).select(F.col("doc_id").alias(key)), key).drop(key)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` of what is left."""
    rows = encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return rows.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("encoding and decoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
