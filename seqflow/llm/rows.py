"""Taking an operator's decisions back to whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seqflow.llm.texts import free_name, same
from seqflow.session import materialize

#: Lets Spark delete a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bits of a bitmap for each id, so that about one other id in so many looks like a listed one, and bits of the largest (32 MB).
BITS_PER_ID, MOST_BITS = 16, 1 << 28


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go once they have been used."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that no later plan reads."""
    for df in frames:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _marked(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a boolean column, and its name: false where the id is surely not in ``ids``.

    A bitmap of hashed ids meets the rows where they are. It is bounded: ids beyond that make more rows look listed.
    """
    bits = min(MOST_BITS, 1 << max(15, (BITS_PER_ID * ids.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(bits)) + 1
    bucket, bitmap = free_name(docs, "__bucket"), free_name(docs, "__bitmap")
    bitmaps = ids.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    listed = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    met = docs.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), bucket, "left")
    mark = free_name(docs, "__listed")
    return met.withColumn(mark, listed).drop(bucket, bitmap), mark


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, a stored frame of that one column; hardly any other row is shuffled."""
    marked, mark = _marked(docs, ids, id_col)
    return marked.where(F.col(mark)).drop(mark).join(ids, id_col, "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The other rows of ``docs``, those with a null id too; few but the rows that go are shuffled."""
    marked, mark = _marked(docs, ids, id_col)
    unsure = marked.where(F.col(mark)).join(ids, id_col, "left_anti")
    return marked.where(~F.col(mark)).unionByName(unsure).drop(mark)


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a bigint of its own for every row, and that column's name.

    The id itself where ids are unique and none is null. Otherwise rows are numbered, and stored with
    their number, so that a later plan sees the same one.
    """
    key, id_ = free_name(docs, "__key"), F.col(f"`{id_col}`").cast("bigint")
    shared = docs.groupBy(id_.alias("id")).count().where("id IS NULL OR count > 1")
    if shared.isEmpty():
        return docs.withColumn(key, id_), key
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered-rows"), key


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str | list[str] = "doc_id", one_per_id: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id, of one or more columns, is in ``kept``, with all their columns; null ids match null.

    With ``one_per_id``, one row stays of those that repeat an id. Only these few are ranked; the
    others are not shuffled again.
    """
    ids = [id_col] if isinstance(id_col, str) else id_col
    out = same(docs, kept.distinct(), ids, "left_semi")
    if not one_per_id:
        return out
    quoted = [f"`{c}`" for c in ids]
    repeated = kept.groupBy(*quoted).count().where("count > 1").select(*quoted)
    if repeated.isEmpty():
        return out
    first = W.partitionBy(*quoted).orderBy(*[F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])])
    nth = free_name(docs, "__nth")
    some = same(out, repeated, ids, "left_semi").withColumn(nth, F.row_number().over(first))
    return same(out, repeated, ids, "left_anti").unionByName(some.where(F.col(nth) == 1).drop(nth))
