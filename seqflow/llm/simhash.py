"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments and each segment is mapped to the
number of its set bits. That point of small counts is kept in thermometer form
(the bits of each segment sorted), where the Manhattan distance of two points is
the number of differing bits. It never exceeds the Hamming distance of the
fingerprints, so points further apart than the bound cannot link.

The range join deals the segments into ``bound + SHARED`` groups of coordinates.
Two points within the bound agree on all coordinates of at least ``SHARED``
groups, so they meet in a cell of the grid that these groups span. Inside a cell
pairs are refused by their Manhattan distance first and verified bit by bit after.
Only a spanning forest of each cell's links leaves its task, so a family of
near copies costs a row per member and not a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.components import connected_components
from seqflow.llm.rows import stored
from seqflow.llm.texts import map_texts, plain_words, utf8

BITS = 64
SEED = 42
SEGMENT = 2       # bits in a segment: counts 0, 1, 2
SHARED = 3        # groups of coordinates that span a cell
CELL_ROWS = 4096  # a cell with more distinct fingerprints is joined in blocks
HOT_CELLS = 500_000  # a list of large cells beyond this is not broadcast
FREQUENT = 100_000  # fingerprints of more than one row in this many (and 1000 rows) are joined by broadcast
_LOW = 0x5555555555555555
_STEP = 1 << 18


def _bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes have each bit set; hashes lie text after text."""
    sums = np.zeros((len(counts), BITS), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), _STEP):
        part, who = hashes[at:at + _STEP], owner[at:at + _STEP]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # Sums of up to 255 rows fit a byte; adding bytes is far quicker than adding wide numbers.
        starts = np.unique(np.concatenate([first, np.arange(0, len(part), 255)]))
        small = np.add.reduceat(bits, starts, axis=0, dtype=np.uint8)
        np.add.at(sums, who[starts], small)
    return sums


def fingerprint_words(texts: list[list[bytes]], words: int) -> np.ndarray:
    """SimHash of each word list; zero without words."""
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, w in enumerate(texts):
        if not w:
            continue
        grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*[w[k:] for k in range(words)]))
        before = len(hashes)
        hashes.extend([digest(g, SEED) for g in grams])
        counts[i] = len(hashes) - before
    set_bits = 2 * _bit_sums(np.array(hashes, np.uint64), counts) > counts[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) for every row; null text counts as empty.

    A bit is set if it is set in over half of the hashes of the text's word shingles, repeats
    included; fewer words make one shingle, none make the fingerprint zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = fingerprint_words([plain_words(t) for t in utf8(b.column(1))], words)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(source, ["doc_id", "text"], run, "doc_id bigint, fp bigint")


def embedding(fp: Column) -> Column:
    """The segment counts of a fingerprint, in thermometer form: each segment's bits sorted."""
    other = F.shiftrightunsigned(fp, 1)
    low, high = fp.bitwiseOR(other).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(other).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _embed(fps: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fps | fps >> one) & low) | ((fps & fps >> one) & low) << one


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def grid_masks(bound: int) -> list[int]:
    """For every choice of ``SHARED`` groups, the bits of their coordinates."""
    segments = BITS // SEGMENT
    groups = bound + SHARED
    part = [0] * groups
    for s in range(segments):  # neighbouring segments in different groups
        part[s % groups] |= ((1 << SEGMENT) - 1) << (SEGMENT * s)
    return [sum(part[g] for g in chosen) for chosen in combinations(range(groups), SHARED)]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links ``(member, smallest member)`` that connect what the links ``a, b`` among ``n`` rows connect."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _link_cells(bound: int):
    """Links within the cells of rows sorted by cell; the last cell of a batch waits for its rest."""
    def links(cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        points = _embed(fps)
        left, right = [], []
        gap, at = 1, np.arange(len(fps))
        while True:  # rows ``gap`` apart, as long as any two of them share a cell
            at = at[at + gap < len(fps)]
            at = at[cell[at] == cell[at + gap]]
            if not len(at):
                break
            near = at[np.bitwise_count(points[at] ^ points[at + gap]) <= bound]  # the lower bound
            near = near[np.bitwise_count(fps[near] ^ fps[near + gap]) <= bound]
            left.append(near), right.append(near + gap)
            if sum(map(len, left)) > 1 << 20:  # a dense cell: keep only what connects
                x, y = forest(np.concatenate(left), np.concatenate(right), len(fps))
                left, right = [x], [y]
            gap += 1
        if left:
            x, y = forest(np.concatenate(left), np.concatenate(right), len(fps))
        else:
            x = y = np.zeros(0, np.int64)
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[x]), pa.array(signed[y])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.concatenate([cell, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield links(cell[:whole], fps[:whole])
                cell, fps = cell[whole:], fps[whole:]
        if len(cell):
            yield links(cell, fps)
    return run


def _split_hot(cells: DataFrame, hot: DataFrame, cell_rows: int) -> DataFrame:
    """Rows of cells in ``hot`` dealt to pairs of blocks, so that any two rows still meet in one task."""
    blocks = F.ceil(F.col("n") * 2 / cell_rows).cast("bigint")
    rows = cells.join(hot, "cell").select("cell", "fp", blocks.alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")


def near_links(fps: DataFrame, bound: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all pairs within ``bound`` bits.

    Pairs that differ in more bits may be named too, where a chain of close pairs in one cell connects them.
    """
    point = F.col("point")
    spots = [F.xxhash64(F.lit(i), point.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(grid_masks(bound))]
    cells = (fps.select("fp").distinct().withColumn("point", embedding(F.col("fp")))
             .select(F.explode(F.array(*spots)).alias("cell"), "fp"))
    hot = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows), "hot-cells")
    many = hot.count()
    if many:
        listed = F.broadcast(hot) if many <= HOT_CELLS else hot
        cells = cells.join(listed, "cell", "left_anti").unionByName(_split_hot(cells, listed, cell_rows))
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_link_cells(bound), "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                   bound: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows link when their fingerprints differ in ``bound`` bits or fewer; ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and link like any other; a null
    id is never the smallest (null only where a component has no other); rows that repeat an id are
    separate rows with the component of their own text. Other columns are not read; an empty table
    gives no rows. A text is held whole in one task; its hashes are summed in bounded steps.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = connected_components(near_links(first, bound, cell_rows))
    linked = found.join(first.withColumnRenamed("fp", "id"), "id")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = found.join(least, "component").select(F.col("id").alias("fp"), "least", F.lit(True).alias("linked"))
    named = stored(first.join(moved, "fp", "left").select(
        "fp", "n", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id")), "named-fingerprints")
    # A fingerprint that many rows share would fill one task of the join; there are FREQUENT of these at most.
    often = max(1000, (first.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    few, many = (named.where(c).drop("n") for c in (F.col("n") <= often, F.col("n") > often))
    apart = rows.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp", "left")
    return apart.unionByName(rows.join(F.broadcast(many), "fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
