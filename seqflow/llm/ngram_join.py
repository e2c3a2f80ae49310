"""Documents whose word n-gram sets overlap, by a blocked sparse matrix product.

The matrix has a row for each document and a column for each n-gram. Its
product with its own transpose holds the overlap of every pair; only entries
that reach the bound given by the two sizes are wanted.

* *Blocks.* Two sets of sizes a and b that reach the threshold differ in at most
  ``d(a, b)`` columns. The columns are dealt into more than d ranges by their
  hash, so the two rows agree completely on at least one range: rows are brought together by
  the fingerprints of their ranges, one family of ranges for each level of sizes. All other pairs are
  below the bound, and so are rows that agree with others in fewer ranges than any link needs. Nothing is sampled.
* *Hubs.* Among rows with one fingerprint the most central is the hub; each of
  the others is multiplied with it once. Rows that link to the hub are one component and need no
  product with each other.
* *Rest.* A row that misses its hub's bound is multiplied with all rows of that
  hub, in blocks of bounded size. Rows are stored as differences from the hub,
  which keeps the product sparse where a hub has thousands of near copies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from seqflow.llm.components import connected_components
from seqflow.llm.rows import release, stored, with_ids, without_ids
from seqflow.llm.texts import Memo, map_texts, offsets, plain_words, utf8

WORDS = 4
PERCENT = 85
BLOCK_ROWS = 2048
BLOCK_BYTES = 8 << 20
NEED = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one n-gram as a whole."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.hash = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        if not words:
            return np.empty(0, np.uint64)
        ids = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(ids))
        out = np.full(len(ids) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = mix(out * _GOLD + ids[k:k + len(out)])
        return np.unique(out)


class Levels:
    """Levels of set sizes such that linked sets are at most one level apart."""

    def __init__(self, percent: int = PERCENT):
        starts = [1]
        while starts[-1] < 1 << 31:  # more n-grams than a text of 2 GB has
            starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
        self.starts = starts
        #: Most columns in which linked sets can differ if the larger is of this level.
        self.differing = [2 * (s - 1) * (100 - percent) // (100 + percent) for s in starts[1:]]

    def of(self, size: int) -> int:
        return bisect_right(self.starts, size) - 1

    def fingerprints(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each (level, range) in which the set has columns, and its tag.

        The tag holds the level and, below, in how many of the set's ranges a linked set agrees at least.
        A level with no room for a difference is left out: sets there link only if equal. A set with
        columns in no more ranges than may differ also gives its empty ranges. A linked set that doesn't
        give its own meets it in one range at least, so no more is asked.
        """
        out, tags = [], []
        own = self.of(len(columns))
        for level in (own, own + 1):
            d = self.differing[level]
            if d == 0:
                continue
            ranges = d + 3 + d // 8
            # Ranges of hash values: the columns are sorted, so each range is a slice.
            part = ((columns >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            sums = np.add.reduceat(mix(columns ^ _M1), first)
            at = part[first]
            need = len(first) - d  # the others of the agreeing ranges may be empty
            if need <= 0:
                need = 1
                empty = np.setdiff1d(np.arange(ranges, dtype=np.uint64), at)
                at, sums = np.concatenate([at, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            out.append(mix(sums + mix(at + np.uint64(level << 32))))
            tags.append(np.full(len(at), level * NEED + min(need, NEED - 1), np.int32))
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        return np.concatenate(out), np.concatenate(tags)


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _sets(words: int):
    """Size and two fingerprints of every row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            sizes, one, two = [], [], []
            for t in utf8(b.column(1)):
                s = shingle(t)
                sizes.append(len(s))
                one.append(np.add.reduce(mix(s)) if len(s) else np.uint64(0))
                two.append(np.add.reduce(mix(s ^ _GOLD)) if len(s) else np.uint64(0))
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64))],
                ["doc_id", "n", "k1", "k2"])
    return run


def _fingerprints(words: int, percent: int):
    """``sig, rep, tag``; equal sets inside a batch count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, levels = Shingler(words), Levels(percent)
        for b in batches:
            sets: dict[bytes, int] = {}
            for i, t in zip(b.column(0).cast(pa.int64()).to_pylist(), utf8(b.column(1))):
                s = shingle(t)
                if len(s) and i is not None:
                    key = s.tobytes()
                    sets[key] = min(i, sets.get(key, i))
            made = [levels.fingerprints(np.frombuffer(k, np.uint64)) for k in sets]
            if made:
                reps = np.repeat(np.array(list(sets.values()), np.int64), [len(s) for s, _ in made])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([s for s, _ in made]).view(np.int64)), pa.array(reps),
                    pa.array(np.concatenate([t for _, t in made]))], ["sig", "rep", "tag"])
    return run


def _rows(words: int):
    """The sparse rows themselves: sorted column hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array([shingle(t).tobytes() for t in utf8(b.column(1))], pa.binary())],
                ["id", "columns"])
    return run


def _against_hub(percent: int):
    """Product of each row with its hub's row: linked or not, and where the two differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, deltas, own, sizes = [], [], [], []
            for mine, other in zip(b.column(2), b.column(3)):
                x = np.frombuffer(mine.as_buffer(), np.uint64)
                y = np.frombuffer(other.as_buffer(), np.uint64)
                delta = np.setxor1d(x, y, assume_unique=True)
                hit = linked((len(x) + len(y) - len(delta)) // 2, len(x), len(y), percent)
                ok.append(hit)
                sizes.append(len(x))
                deltas.append(delta.tobytes())
                own.append(None if hit else x.tobytes())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ok, pa.bool_()),
                pa.array(deltas, pa.binary()), pa.array(own, pa.binary())],
                ["hub", "rep", "n", "linked", "delta", "own"])
    return run


def block_links(rows: pa.Table, percent: int) -> pa.Table:
    """One block of the product: rows that missed the hub against a block of the hub's rows.

    Overlaps accumulate column by column, ``x.y = hub part + sum of signed entries of x - hub``; a spanning
    forest of the entries that reach their bound comes back.
    """
    cols = {c: rows.column(c).to_pylist() for c in ("rep", "n", "linked", "delta", "own", "asks")}
    members = [i for i, a in enumerate(cols["asks"]) if not a]
    askers = [i for i, a in enumerate(cols["asks"]) if a]
    delta = [np.frombuffer(d, np.uint64) for d in cols["delta"]]
    reps = np.array([cols["rep"][i] for i in members], np.int64)
    sizes = np.array([cols["n"][i] for i in members], np.int64)
    widths = np.array([len(delta[i]) for i in members], np.int64)
    entries = np.concatenate([delta[i] for i in members]) if members else np.empty(0, np.uint64)
    order = np.argsort(entries, kind="stable")
    entries, owners = entries[order], np.repeat(np.arange(len(members)), widths)[order]
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    hub = -1  # all rows linked to the hub are one set from the start
    for i in range(len(cols["rep"])):
        if cols["linked"][i]:
            root[cols["rep"][i]] = hub
    out: list[tuple[int, int]] = []
    for i in askers:
        y, dy, ny, me = np.frombuffer(cols["own"][i], np.uint64), delta[i], cols["n"][i], cols["rep"][i]
        near = len(dy) <= len(y)
        wanted = dy if near else y
        lo, hi = np.searchsorted(entries, wanted, "left"), np.searchsorted(entries, wanted, "right")
        counts = hi - lo
        at = np.repeat(lo - offsets(counts)[:-1], counts) + np.arange(counts.sum())
        if near:
            shared = np.bincount(owners[at], minlength=len(members))
            overlap = (sizes + ny - (widths + len(dy) - 2 * shared)) // 2
        else:
            sign = np.where(np.isin(y, dy, assume_unique=True), 1, -1)
            moved = np.bincount(owners[at], weights=np.repeat(sign, counts), minlength=len(members))
            overlap = np.count_nonzero(sign < 0) + moved.astype(np.int64)
        for rep in reps[linked(overlap, sizes, ny, percent)].tolist():
            a, b = find(me), find(rep)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((me, rep))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _rest(products: DataFrame, percent: int) -> DataFrame:
    """Links of rows that missed their hub, block by block."""
    size = F.octet_length("delta") + F.coalesce(F.octet_length("own"), F.lit(0)) + 16
    per_hub = products.groupBy("hub").agg(
        F.count("*").alias("members"), F.sum(size).alias("bytes"), F.sum((~F.col("linked")).cast("int")).alias("missed"))
    blocks = per_hub.where("missed > 0 AND members > 1").select("hub", F.greatest(
        F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = products.join(blocks, "hub").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = dealt.where("NOT linked").withColumn("i", F.col("mine")).withColumn("j", every)
    asked = dealt.withColumn("j", F.col("mine")).withColumn("i", every)
    cols = ["hub", "i", "j", "rep", "n", "linked", "delta", "own", "asks"]
    both = asks.withColumn("asks", F.lit(True)).select(*cols).unionByName(
        asked.withColumn("asks", F.lit(False)).withColumn("own", F.lit(None).cast("binary")).select(*cols))
    return both.groupBy("hub", "i", "j").applyInArrow(lambda t: block_links(t, percent), "a bigint, b bigint")


def _able(met: DataFrame) -> DataFrame:
    """Without rows that meet others in fewer ranges than any link of theirs needs.

    A range that is left with one row links nothing, and a row with too few ranges links with nobody at that
    level: its size bound says in how many ranges a partner agrees.
    """
    live = met.groupBy("sig").agg(F.count("*").alias("rows")).where("`rows` > 1")
    met = met.drop("rows").join(live, "sig")
    enough = met.groupBy("rep", "tag").count().where(F.col("count") >= F.col("tag") % NEED).select("rep", "tag")
    return met.join(enough, ["rep", "tag"], "left_semi")


def _chosen_hubs(assigned: DataFrame) -> DataFrame:
    """``hub, rep``: hubs that a row meets in few ranges are left out while these ranges are under half of what a link needs.

    A linked pair agrees in as many ranges as either side needs. Both sides together leave out fewer, so
    at least one range, and its hub, remains for both.
    """
    times = assigned.groupBy("rep", "tag", "hub").count()
    fewest = W.partitionBy("rep", "tag").orderBy("count", "hub").rowsBetween(W.unboundedPreceding, 0)  # hubs of one row
    so_far = times.withColumn("so_far", F.sum("count").over(fewest))
    return so_far.where(2 * F.col("so_far") >= F.col("tag") % NEED).select("hub", "rep").distinct()


def ngram_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, links) for ``doc_id, text`` rows.

    ``sets``: ``doc_id, n, rep`` with the smallest id that has the same set. ``links``: enough of the
    linked pairs of such ids to reach every set of a component from every other.
    """
    sets = stored(map_texts(docs, ["doc_id", "text"], _sets(words), "doc_id bigint, n bigint, k1 bigint, k2 bigint"), "sets")
    classes = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    named = stored(sets.join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", "rep"), "named-sets")

    # Only rows whose id stands for a set are fingerprinted: one row of every set is among them.
    reps = named.where("n > 0").select(F.col("rep").alias("doc_id")).distinct()
    copies = stored(named.where("n > 0").select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "copies")
    sigs = map_texts(without_ids(docs, copies, "doc_id"), ["doc_id", "text"], _fingerprints(words, percent),
                     "sig bigint, rep bigint, tag int")
    # Counted where they meet: the fingerprints of all texts are as large as the texts and are made and moved once.
    meeting = sigs.withColumn("rows", F.count("*").over(W.partitionBy("sig")))  # rows that share a range
    shared = stored(meeting.where("`rows` > 1"), "met")
    met = stored(_able(_able(shared)), "able")
    release(sets, copies, shared)
    central = met.groupBy("rep").agg(F.sum("rows").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("rep")).alias("low")))["low"]
    hubs = met.join(central, "rep").groupBy("sig").agg((-best).alias("hub"), F.count("*").alias("members"))
    pairs = stored(_chosen_hubs(met.join(hubs.where("members > 1"), "sig").where("hub != rep")), "pairs")

    ids = pairs.select(F.col("rep").alias("doc_id")).unionByName(pairs.select(F.col("hub").alias("doc_id")))
    wanted = stored(ids.distinct(), "wanted")
    rows = stored(map_texts(with_ids(docs, wanted, "doc_id"), ["doc_id", "text"], _rows(words), "id bigint, columns binary"), "rows")
    facing = pairs.join(rows.withColumnsRenamed({"id": "rep", "columns": "mine"}), "rep").join(
        rows.withColumnsRenamed({"id": "hub", "columns": "theirs"}), "hub").select("hub", "rep", "mine", "theirs")
    products = stored(facing.mapInArrow(_against_hub(percent), "hub bigint, rep bigint, n bigint, linked boolean, "
                                        "delta binary, own binary"), "products")
    links = products.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(
        _rest(products, percent))
    return named, links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Sets link when ``100 * intersection >= percent * union``. The component is the smallest id
    reachable. A null or empty text has no n-grams and is alone; one with fewer words than ``words``
    is one n-gram. Rows that repeat an id are one document as to its links; a row with a null id takes
    the component of its equals, else null.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named, links = ngram_links(source, words, percent)
    found = connected_components(links).withColumnRenamed("id", "rep")
    return named.join(found, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
