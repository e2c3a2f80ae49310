"""Exact duplicates through an extendible-hash index.

Each text, normalised (A-Z lower-cased, null as empty), has a 64-bit key. A
directory maps the leading bits of a key to a bucket; it starts with one bucket
and doubles whenever a bucket of the largest depth is over its capacity, which
then splits. Every bucket covers one range of keys and has one owner task,
which reads its entries in key order, chains different texts that share a key
and tells them apart by comparing bytes.

A group of copies may own most rows: the map side collapses copies inside each
batch first, and an owner reads what is left as a stream, holding only the
chain of one key.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.texts import map_texts, same, utf8
from seqflow.session import materialize

NARROW = "doc_id bigint, key bigint, text_sha256 string, n_bytes bigint"
LEADER = "key bigint, text binary, doc_id bigint, n bigint"
CLASS = "key bigint, text_sha256 string, keep_id bigint, group_size bigint, chain int"
BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 1 << 16
FINER = 4  # a bucket may be split this many times beyond an even share


def _key(text: bytes, key_bits: int) -> int:
    """The leading ``key_bits`` of a 64-bit hash as a signed number."""
    h = xxhash.xxh3_64_intdigest(text) >> (64 - key_bits) << (64 - key_bits)
    return h - (1 << 64) if h >> 63 else h


def _describe(key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.lower() for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()),
                pa.array([_key(t, key_bits) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "key", "text_sha256", "n_bytes"])
    return run


def text_class(text: Column) -> Column:
    """``text_sha256`` of a text: equal for texts that count as copies."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)


def _collapse(key_bits: int):
    """One row for each distinct text of a batch: its largest id and its number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[bytes, list] = {}
            for i, t in zip(b.column(0).cast(pa.int64()).to_pylist(), utf8(b.column(1))):
                g = groups.setdefault(t.lower(), [None, 0])
                g[1] += 1
                if g[0] is None or (i is not None and i > g[0]):
                    g[0] = i
            yield pa.RecordBatch.from_arrays([
                pa.array([_key(t, key_bits) for t in groups], pa.int64()),
                pa.array(list(groups), pa.binary()),
                pa.array([g[0] for g in groups.values()], pa.int64()),
                pa.array([g[1] for g in groups.values()], pa.int64())], ["key", "text", "doc_id", "n"])
    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order: compare bytes within the chain of the current key."""
    done: list[tuple] = []
    key, chain = None, []

    def close() -> None:
        done.extend((key, hashlib.sha256(t).hexdigest(), top, n, at) for at, (t, top, n) in enumerate(chain))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["key", "text_sha256", "keep_id", "group_size", "chain"])

    for b in batches:
        keys, ids, counts = (b.column(i).to_pylist() for i in (0, 2, 3))
        for i, k in enumerate(keys):
            if k != key:
                if key is not None:
                    close()
                key, chain = k, []
            text = b.column(1)[i].as_py()
            for entry in chain:
                if entry[0] == text:
                    entry[2] += counts[i]
                    if ids[i] is not None and (entry[1] is None or ids[i] > entry[1]):
                        entry[1] = ids[i]
                    break
            else:
                chain.append([text, ids[i], counts[i]])
        if len(done) >= 10_000:
            yield flush()
    if key is not None:
        close()
    if done:
        yield flush()


def grow_directory(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of every directory slot, for ``sizes`` of 2**k equal key ranges.

    Extendible hashing: one bucket at first; an overfull bucket splits, and the
    directory doubles when that bucket already uses all its bits. A single key
    range is never split further.
    """
    finest = int(sizes.size).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def load(prefix: int, depth: int) -> int:
        width = 1 << (finest - depth)
        return int(before[(prefix + 1) * width] - before[prefix * width])

    slots, depth = np.zeros(1, dtype=np.int64), 0
    buckets = [(0, 0)]  # prefix, number of its bits
    waiting = [0]
    while waiting:
        b = waiting.pop()
        prefix, bits = buckets[b]
        if load(prefix, bits) <= capacity or bits == finest:
            continue
        if bits == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        buckets[b] = (2 * prefix, bits + 1)
        buckets.append((2 * prefix + 1, bits + 1))
        new = len(buckets) - 1
        width = 1 << (depth - bits - 1)
        slots[(2 * prefix + 1) * width:(2 * prefix + 2) * width] = new
        waiting += [b, new]
    return np.repeat(slots, 1 << (finest - depth))


def directory(narrow: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, np.ndarray]:
    """(bits, bucket of every slot); at most ``MAX_BUCKETS * 2**FINER`` slots whatever the input's size."""
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = max(bucket_bytes, total // MAX_BUCKETS)
    bits = max(1, (total // capacity).bit_length()) + FINER
    distinct = narrow.groupBy("key", "text_sha256").agg(F.max("n_bytes").alias("n_bytes"))
    slot = F.shiftrightunsigned("key", 64 - bits)
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in distinct.groupBy(slot.alias("slot")).agg(F.sum("n_bytes").alias("n")).collect():
        sizes[r["slot"]] = r["n"]
    return bits, grow_directory(sizes, capacity)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64,
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of rows with equal normalised text the largest id stays. A null text counts
    as empty; a null id stays only where its group has no other; rows that
    repeat an id and a text are all marked alike. Empty input gives no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    narrow = materialize(map_texts(source, ["doc_id", "text"], _describe(key_bits), NARROW), "dedup-keys")
    bits, slots = directory(narrow, bucket_bytes)
    buckets = int(slots.max()) + 1
    spark = docs.sparkSession
    # Bounded by MAX_BUCKETS * 2**FINER numbers.
    lookup = spark.sparkContext.broadcast(slots)

    def with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _collapse(key_bits)(batches):
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield b.append_column("bucket", pa.array(lookup.value[at.astype(np.int64)].astype(np.int32)))

    leaders = map_texts(source, ["doc_id", "text"], with_bucket, f"{LEADER}, bucket int")
    owned = leaders.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("key").drop("bucket")
    classes = materialize(owned.mapInArrow(_own, CLASS), "dedup-index")
    marked = narrow.drop("n_bytes").join(classes, ["key", "text_sha256"], "left")
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         "text_sha256")
