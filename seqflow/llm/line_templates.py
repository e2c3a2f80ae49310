"""Recurring lines, by a log-template tree, in DataFrame operations only.

Every line gets a shape: its words, those with a digit masked. The tree has a
fixed depth: the number of words, then the first words of the shape, lead to a leaf. Within a leaf a
word stays constant where it stands in enough (document, shape) pairs, and becomes a variable
field elsewhere: shapes that differ in variable fields only share a template.
Lines of templates that recur in enough different documents are dropped, if enough of the words
behind those that led to the leaf are constant. A line of many words is dropped as soon as
a second document has its shape.

Counts are aggregated ahead of every shuffle; only leaves with enough lines reach the word level.
A leaf with fewer lines than a template needs documents has no template, and long lines are counted beside the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.rows import stored
from seqflow.llm.texts import same

LEAD = 3
MIN_DOCS = 10
CONSTANT = 0.5
LONG_WORDS = 50  # a line of more words counts as a passage
FIELD = "<*>"


def shape(line: Column) -> Column:
    """Words separated by one space, those with an ASCII digit masked."""
    even = F.trim(F.regexp_replace(line, "[ \t\r]+", " "))
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(even)


def _name(shape_: Column) -> Column:
    return F.struct(F.xxhash64(shape_).alias("a"), F.xxhash64(F.lit(1), shape_).alias("b"))


def templates(lines: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, lead: int = LEAD) -> DataFrame:
    """``doc_id, name`` of lines whose template recurs, from ``doc_id, shape, name, words, lead`` of each document and shape."""
    leaf = ["words", "lead"]
    leaves = lines.groupBy(*leaf).count().where(F.col("count") >= min_docs).select(*leaf)
    shapes = stored(lines.join(leaves, leaf, "left_semi").groupBy("shape", "name", *leaf).agg(F.count("*").alias("n")), "shapes")
    words = shapes.select("shape", "name", *leaf, "n", F.posexplode(F.split("shape", " ")).alias("pos", "word"))
    fixed = words.groupBy(*leaf, "pos", "word").agg(F.sum("n").alias("support")).where(
        F.col("support") >= min_docs).withColumn("fixed", F.col("word") != FIELD)
    marked = words.join(fixed, [*leaf, "pos", "word"], "left")
    is_fixed = F.coalesce(F.col("fixed"), F.lit(False))
    made = marked.groupBy("shape", "name", *leaf, "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(  # the words of one line
            "pos", F.when(F.col("fixed"), F.col("word")).otherwise(F.lit(FIELD)).alias("word")))), lambda x: x["word"]),
            " ").alias("template"),
        F.count_if(is_fixed).alias("constants"), F.count_if(is_fixed & (F.col("pos") >= lead)).alias("behind"))
    enough = (F.col("constants") >= F.col("words") * constant) & (F.col("behind") >= F.greatest(F.col("words") - lead, F.lit(0)) * constant)
    good = stored(made.where(enough).select("name", F.xxhash64("template").alias("t1"), F.xxhash64(F.lit(1), "template").alias("t2"), "n"), "templates")
    # One document may hold many lines of a template: only lines of templates with enough of them are asked for their document.
    often = good.groupBy("t1", "t2").agg(F.sum("n").alias("pairs")).where(F.col("pairs") >= min_docs).select("t1", "t2")
    asked = good.join(often, ["t1", "t2"], "left_semi").select("name", "t1", "t2")
    held = stored(lines.select("doc_id", "name").join(asked, "name"), "template-lines")
    documents = held.select("doc_id", "t1", "t2").distinct().groupBy("t1", "t2").agg(F.count("*").alias("docs"))
    recurring = documents.where(F.col("docs") >= min_docs).select("t1", "t2")
    return held.join(recurring, ["t1", "t2"], "left_semi").select("doc_id", "name")


def passages(lines: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id, name`` of lines of more than ``long_words`` words whose shape a second document has."""
    long = lines.where(F.col("words") > long_words).select("doc_id", "name")
    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))  # all null ids count as one document
    shared = long.groupBy("name").agg(F.min(ids).alias("a"), F.max(ids).alias("b")).where("a < b").select("name")
    return long.join(shared, "name", "left_semi")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, constant: float = CONSTANT,
                         id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` for every row: the text without recurring lines.

    Lines end at a line feed. Lines without words always stay. A template recurs in ``min_docs`` different
    documents, with at least ``constant`` of its words constant, and as many of those behind the first
    ``lead``; a line of more than ``long_words`` words recurs in two. Ids tell documents apart: rows that
    share an id, and all rows with a null one, are one document. A null text counts as empty (one line).
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    per_doc = source.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.split("text", "\n"), lambda x: shape(x)))).alias("shape")).where("shape != ''")
    lines = stored(per_doc.select("doc_id", "shape", _name(F.col("shape")).alias("name"), F.size(F.split("shape", " ")).alias("words"),
                                  F.substring_index("shape", " ", lead).alias("lead")), "lines")
    hits = stored(templates(lines, min_docs, constant, lead).unionByName(passages(lines, long_words)).distinct(), "recurring")
    by_doc = hits.groupBy("doc_id").agg(F.collect_set("name").alias("gone"))  # lines of one document
    marked = same(source, by_doc, ["doc_id"], "left")
    all_lines = F.split("text", "\n")
    kept = F.filter(all_lines, lambda x: ~F.array_contains("gone", _name(shape(x))))
    out = marked.withColumn("lines", F.size(all_lines)).withColumn(
        "kept", F.when(F.col("gone").isNull(), all_lines).otherwise(kept))
    return out.select("doc_id", F.col("lines").cast("bigint").alias("n_lines"),
                      (F.col("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("text"))
