"""Embedding distances between a candidate set and a reference set."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.functions.vectors import cosine_distance, l2_distance
from seqflow.operators.ordered import join_on
from seqflow.operators.segments import segment_bounds
from seqflow.session import materialize

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20   # of reference rows that a task compares with
PART_PAIRS = 1 << 27    # pairs of one part, about
CELL_COPIES = 16        # parts into which the candidates of a cell are cut, at most
PIVOTS = 32        # cells of a pruned grid, at most
SLACK = 1e-9       # relative; bounds are compared with rounding errors in mind
# Distances are kept to 12 decimals, so equal ones rank as ties no matter in
# which order their terms were added up.
DECIMALS = 12
_RESULT = "struct<cos:double,l2:double>"


def vector_width(ref: DataFrame, vec_col: str) -> int | None:
    """The commonest width of the reference vectors (ties: the smallest); null without any."""
    sizes = ref.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.col("n").desc(), "w").first()
    return row["w"] if row else None


def usable(vec: Column | str, width: int | None) -> Column:
    """True for a vector of that width whose elements are all finite numbers."""
    if width is None:
        return F.lit(False)
    v = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


class _Reference:
    """Reference rows, measured once for many blocks of candidates."""

    def __init__(self, r: np.ndarray, reduction: str):
        self.rows, self.reduction = len(r), reduction
        if reduction == "min" and np.isnan(r).any():
            r = r[~np.isnan(r).any(1)]
        self.r, self.norm = r, np.sqrt((r * r).sum(1))
        self.unit = r / np.where(self.norm == 0, 1.0, self.norm)[:, None]

    def nearest(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``a``: reduced cosine and Euclidean distance to the rows.

        Matrix products find the close pairs; the winning Euclidean distances are
        then recomputed from differences so that no digits are lost. A pair whose distance is NaN
        doesn't count for the nearest; the mean and a row that has no other pair become NaN.
        """
        r, nr = self.r, self.norm
        if not len(r):
            return np.full(len(a), np.nan), np.full(len(a), np.nan)
        cos_out, l2_out = np.empty(len(a)), np.empty(len(a))
        step = max(1, (1 << 22) // max(1, len(r)))
        for at in range(0, len(a), step):
            x = a[at:at + step]
            nx = np.sqrt((x * x).sum(1))
            cos = 1.0 - (x / np.where(nx == 0, 1.0, nx)[:, None]) @ self.unit.T
            sq = (nx * nx)[:, None] + (nr * nr)[None, :] - 2.0 * (x @ r.T)
            if self.reduction == "mean":
                cos_out[at:at + step] = cos.mean(1)
                l2_out[at:at + step] = np.sqrt(np.maximum(sq, 0.0)).mean(1)
                continue
            cos_out[at:at + step] = np.fmin.reduce(cos, axis=1)
            slack = 1e-12 * (nx * nx + (nr * nr).max())
            best = np.full(len(x), np.nan)
            close = (sq <= (np.fmin.reduce(sq, axis=1) + slack)[:, None]) | np.isnan(sq)
            rows, cols = np.nonzero(close & ~np.isnan(x).any(1)[:, None])
            for lo in range(0, len(rows), 1 << 16):
                i, j = rows[lo:lo + (1 << 16)], cols[lo:lo + (1 << 16)]
                diff = x[i] - r[j]
                np.fmin.at(best, i, np.sqrt((diff * diff).sum(1)))
            l2_out[at:at + step] = best
        return cos_out, l2_out


def _nearest(a: np.ndarray, r: np.ndarray, reduction: str) -> tuple[np.ndarray, np.ndarray]:
    return _Reference(r, reduction).nearest(a)


def _rows_by_key(keys: pa.Array) -> list[tuple[str, np.ndarray]]:
    """Row numbers of each key, by one sort."""
    codes = keys.dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    number = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
    return [(codes.dictionary[int(number[p[0]])].as_py(), p) for p in parts if len(p)]


def _key(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def _small_reference(cand: DataFrame, ref: DataFrame, vec_col: str, by: list[str],
                     reduction: str, width: int | None) -> DataFrame:
    table = ref.select(_key(by).alias("k"), F.col(vec_col).cast("array<double>").alias("v")).toArrow()
    blocks: dict[str, np.ndarray] = {}
    if len(table):
        vectors = _matrix(table["v"])
        for k, at in _rows_by_key(table["k"]):
            blocks[k] = np.unique(vectors[at], axis=0) if reduction == "min" else vectors[at]
    shared = cand.sparkSession.sparkContext.broadcast(blocks)

    @F.arrow_udf(_RESULT)
    def nearest(k: pa.Array, v: pa.Array) -> pa.Array:
        cos, l2, none = np.full(len(v), np.nan), np.full(len(v), np.nan), np.ones(len(v), bool)
        rows = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            x, known = _matrix(v.take(pa.array(rows))), shared.value
            for name, at in _rows_by_key(k.take(pa.array(rows))):
                if name in known:
                    cos[rows[at]], l2[rows[at]] = _nearest(x[at], known[name], reduction)
                    none[rows[at]] = False
        return pa.StructArray.from_arrays(
            [pa.array(d, mask=none, from_pandas=False) for d in (cos, l2)], ["cos", "l2"])

    known = F.when(usable(vec_col, width), F.col(vec_col).cast("array<double>"))
    return cand.withColumn("_d", nearest(_key(by), known))


def _block_grid(cand: DataFrame, ref: DataFrame, vec_col: str, by: list[str], reduction: str,
                block_rows: int, width: int | None) -> DataFrame:
    """Both sides are cut into parts; each task streams candidates past the reference rows
    of one part, and parts merge by row number."""
    vec = F.col(vec_col).cast("array<double>").alias("v")
    # Stored, so that a retried task sees the same row numbers. They, not the
    # vectors or ids, choose the part: copies spread over all parts.
    numbered = materialize(cand.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    left = numbered.where(usable(vec_col, width)).select(_key(by).alias("k"), F.col("_row").alias("id"), vec)
    right = materialize(ref.select(_key(by).alias("k"), F.monotonically_increasing_id().alias("rid"), vec), "reference")
    partial = _compare(left, right, ["k"], reduction, block_rows)
    if reduction == "mean":
        cos = F.sum(F.col("cos") * F.col("n")) / F.sum("n")
        l2 = F.sum(F.col("l2") * F.col("n")) / F.sum("n")
    else:
        cos, l2 = F.min("cos"), F.min("l2")
    merged = partial.groupBy(F.col("id").alias("_row")).agg(F.struct(cos.alias("cos"), l2.alias("l2")).alias("_d"))
    return numbered.join(merged, "_row", "left").drop("_row")


def _dealt(left: DataFrame, right: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of both sides (``side`` 0: reference) with the part ``cell, cb, rb`` that compares them.

    A cell whose pairs are many is cut by candidates into at most ``CELL_COPIES`` parts, so that number bounds
    how often a reference row travels. Only a cell of more than ``HELD_BYTES`` is cut by reference rows too.
    """
    held = F.sum(F.size("v").cast("bigint") * 8)
    sizes = left.groupBy(*cell).agg(F.count(F.lit(1)).alias("nc")).join(
        right.groupBy(*cell).agg(F.count(F.lit(1)).alias("nr"), F.greatest(F.lit(1), F.ceil(held / HELD_BYTES)).alias("rbs")), cell)
    sizes = materialize(sizes.select(*cell, "rbs", F.least(F.lit(CELL_COPIES), F.ceil(
        F.col("nc") * F.col("nr") / F.col("rbs") / PART_PAIRS)).cast("bigint").alias("cbs")), "cell-sizes")

    def place(df: DataFrame, key: str, own: str, other: str, side: int) -> DataFrame:
        return (df.join(sizes, cell)
                .withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)))
                .select(*cell, "cb", "rb", F.lit(side).alias("side"), F.col(key).alias("id"), "v"))

    return place(left, "id", "cb", "rb", 1).unionByName(place(right, "rid", "rb", "cb", 0))


def _compare(left: DataFrame, right: DataFrame, cell: list[str], reduction: str, block_rows: int) -> DataFrame:
    """``id, cos, l2, n`` for each ``left(cell..., id, v)`` and each part of ``right(cell..., rid, v)`` of its cell.

    A task holds the reference rows of one part, which come first, and streams the candidates past them in
    blocks of ``block_rows``: a row travels once for each part, however many blocks there are.
    """
    part = [*cell, "cb", "rb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, known = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            bounds = segment_bounds(t, [*part, "side"])
            for a, e in zip(bounds, bounds[1:]):
                if (name := tuple(t[c][a].as_py() for c in part)) != here:
                    here, rows, known = name, [], None
                x = _matrix(t["v"].slice(a, e - a))
                if t["side"][a].as_py() == 0:
                    rows.append(x)
                    continue
                if rows:
                    known, rows = _Reference(np.concatenate(rows), reduction), []
                if known is None:  # no reference rows here
                    continue
                done = [known.nearest(x[at:at + block_rows]) for at in range(0, len(x), block_rows)]
                cos, l2 = (np.concatenate(d) for d in zip(*done))
                yield pa.RecordBatch.from_arrays(
                    [t["id"].slice(a, e - a).combine_chunks(), pa.array(cos), pa.array(l2),
                     pa.array(np.full(e - a, known.rows, np.int64))], ["id", "cos", "l2", "n"])

    dealt = _dealt(left, right, cell).repartition(*part).sortWithinPartitions(*part, "side")
    return dealt.mapInArrow(run, "id bigint, cos double, l2 double, n bigint")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n == 0, 1.0, n)[:, None]


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences, so that a pivot is at distance 0 from itself."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)


def needed_cells(left: DataFrame, right: DataFrame, unit: bool, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``left(k, id, v)`` with the cells that may hold its nearest row, and ``right(k, rid, v)`` with its cell.

    The reference rows lie with their nearest pivot, some of the reference vectors. By the triangle
    inequality all rows of a cell are at least ``d - R`` away, with ``d`` the distance of its pivot and
    ``R`` the cell's radius, and one row is at most ``d + r`` away, with ``r`` the pivot's distance from
    its nearest row. ``cells`` lists ``(bound, cell)`` by bound, without cells beyond the best ``d + r``.
    ``unit`` measures directions: the Euclidean distance of unit vectors grows with the cosine distance.
    """
    picked = right.select("v").orderBy(F.xxhash64("v")).limit(pivots).toArrow()
    points = _matrix(picked["v"]) if len(picked) else np.zeros((0, 1))
    points = np.unique(_unit(points) if unit else points, axis=0)
    shared = left.sparkSession.sparkContext.broadcast(points)  # at most ``pivots`` vectors

    def distances(v: pa.Array) -> np.ndarray:
        x = _matrix(v)
        return _to_pivots(_unit(x) if unit else x, shared.value)

    @F.arrow_udf("struct<cell:int,d:double>")
    def home(v: pa.Array) -> pa.Array:
        d = distances(v)
        cell = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["cell", "d"])

    placed = materialize(right.withColumn("h", home("v")).select("k", "rid", "v", "h.cell", "h.d"), "reference-cells")
    per_cell = placed.groupBy("k", "cell").agg(F.max("d").alias("far"), F.min("d").alias("near"))
    listed = per_cell.groupBy("k").agg(F.collect_list(F.struct("cell", "far", "near")).alias("known"))  # one for each pivot at most

    @F.arrow_udf("array<struct<bound:double,cell:int>>")
    def needed(v: pa.Array, known: pa.Array) -> pa.Array:
        d = distances(v)
        sizes = np.diff(known.offsets.to_numpy())
        row = np.repeat(np.arange(len(v)), sizes)
        cell, far, near = (known.flatten().field(c).to_numpy() for c in ("cell", "far", "near"))
        at = d[row, cell]
        upper = np.full(len(v), np.inf)
        np.minimum.at(upper, row, at + near)
        bound = np.maximum(0.0, at - far - SLACK * (at + far))
        keep = np.flatnonzero(bound <= upper[row] * (1 + SLACK))
        keep = keep[np.lexsort((bound[keep], row[keep]))]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(v)))])
        pairs = pa.StructArray.from_arrays([pa.array(bound[keep]), pa.array(cell[keep])], ["bound", "cell"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)

    out = left.join(listed, "k").withColumn("cells", needed("v", "known")).drop("known")
    return materialize(out, "needed-cells"), placed.drop("d")


def _pruned(left: DataFrame, right: DataFrame, unit: bool, block_rows: int, pivots: int) -> DataFrame:
    """``id, cos, l2`` of the nearest row: first the cell of the least bound, then those that may still be nearer."""
    rows, placed = needed_cells(left, right, unit, pivots)
    one = rows.where(F.size("cells") > 0).select("k", F.col("cells")[0]["cell"].alias("cell"), "id", "v")
    first = materialize(_compare(one, placed, ["k", "cell"], "min", block_rows).groupBy("id").agg(
        F.min("cos").alias("cos"), F.min("l2").alias("l2")), "nearest")
    # The distance of unit vectors at cosine distance c is sqrt(2 c).
    reached = F.sqrt(F.greatest(F.lit(0.0), F.col("cos")) * 2) if unit else F.col("l2")
    more = rows.join(first, "id").select("k", "id", "v", reached.alias("reached"), F.explode(F.slice("cells", F.lit(2), F.size("cells"))).alias("c"))
    more = more.where(F.col("c.bound") <= F.col("reached") * (1 + SLACK) + 1e-7).select("k", F.col("c.cell").alias("cell"), "id", "v")
    rest = _compare(more, placed, ["k", "cell"], "min", block_rows)
    return first.unionByName(rest.drop("n")).groupBy("id").agg(F.min("cos").alias("cos"), F.min("l2").alias("l2"))


def _pruned_grid(cand: DataFrame, ref: DataFrame, vec_col: str, by: list[str], block_rows: int, width: int | None,
                 pivots: int) -> DataFrame:
    """The nearest row by each distance; cells that the bounds rule out are never compared."""
    vec = F.col(vec_col).cast("array<double>").alias("v")
    numbered = materialize(cand.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    left = numbered.where(usable(vec_col, width)).select(_key(by).alias("k"), F.col("_row").alias("id"), vec)
    right = materialize(ref.select(_key(by).alias("k"), F.monotonically_increasing_id().alias("rid"), vec), "reference")
    l2 = _pruned(left, right, False, block_rows, pivots).select("id", "l2")
    # A zero vector has no direction; its cosine distance from anything is 1.
    zero = F.forall("v", lambda x: x == 0)
    cos = _pruned(left, right.where(~zero), True, block_rows, pivots).select("id", "cos")
    with_zero = right.where(zero).select("k").distinct().withColumn("one", F.lit(1.0))
    near = left.select("k", "id").join(l2, "id").join(cos, "id", "left").join(with_zero, "k", "left")
    near = near.select(F.col("id").alias("_row"), F.struct(F.least("cos", "one").alias("cos"), "l2").alias("_d"))
    return numbered.join(near, "_row", "left").drop("_row")


def _reference_bytes(ref: DataFrame, vec_col: str) -> int:
    row = ref.agg(F.sum(F.size(vec_col).cast("bigint") * 8 + 64).alias("b")).first()
    return row["b"] or 0


def nearest_distances(cand: DataFrame, ref: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                      by: Sequence[str] = (), reduction: str = "min", cos_name: str = "min_cos",
                      l2_name: str = "min_l2", max_broadcast_bytes: int = BROADCAST_BYTES,
                      block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Add each candidate's distance to the reference rows of its ``by`` group.

    ``reduction`` is ``min`` (nearest reference row) or ``mean``. A candidate
    without reference rows gets null, and so does one whose vector is null, has a null, NaN or infinite
    element or another width than most of the reference; such reference rows count as absent.
    The reference set is broadcast only if its measured size is within ``max_broadcast_bytes``; beyond
    that a grid is used, for the nearest row one of pivot cells of which the triangle inequality rules
    out most. The result is that of comparing all pairs either way; no pair is ever a row.
    """
    if reduction not in ("min", "mean"):
        raise ValueError("reduction must be 'min' or 'mean'")
    by = list(by)
    width = vector_width(ref, vec_col)
    known = ref.where(usable(vec_col, width))
    if _reference_bytes(known, vec_col) <= max_broadcast_bytes:
        out = _small_reference(cand, known, vec_col, by, reduction, width)
    elif reduction == "mean":
        out = _block_grid(cand, known, vec_col, by, reduction, block_rows, width)
    else:
        out = _pruned_grid(cand, known, vec_col, by, block_rows, width, pivots)
    return out.select(*cand.columns, F.round("_d.cos", DECIMALS).alias(cos_name),
                      F.round("_d.l2", DECIMALS).alias(l2_name))


def pair_distances(cand: DataFrame, ref: DataFrame, ref_id: str, by: Sequence[str] = (),
                   vec_col: str = "embedding",
                   max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The distance matrix itself: one row per candidate and reference row.

    A report for small reference sets; ranking uses ``nearest_distances``,
    which never makes a pair a row. Within ``by`` it is an equi-join; without,
    the reference rows travel as one size-checked array, or as several of bounded size.
    """
    one = F.struct(F.col(ref_id).alias("ref_id"), F.col(vec_col).alias("_rv"))
    if by:
        right = ref.select(*by, F.col(ref_id).alias("ref_id"), F.col(vec_col).alias("_rv"))
        both = join_on(cand, right, list(by), "inner")
    elif (size := _reference_bytes(ref, vec_col)) <= max_broadcast_bytes:
        packed = ref.agg(F.collect_list(one))
        both = (cand.withColumn("_r", F.explode(packed.scalar()))
                .select(*cand.columns, "_r.ref_id", "_r._rv"))
    else:
        blocks = -(-size // max(1, min(max_broadcast_bytes, BLOCK_BYTES)))
        # Stored, so that a retried task sees the same row numbers.
        numbered = materialize(ref.select(one.alias("_one"), F.monotonically_increasing_id().alias("_n")), "reference")
        packed = numbered.groupBy(F.pmod(F.xxhash64("_n"), F.lit(blocks)).alias("_b")).agg(F.collect_list("_one").alias("_rs"))
        every = cand.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        both = (every.join(packed, "_b").withColumn("_r", F.explode("_rs"))
                .select(*cand.columns, "_r.ref_id", "_r._rv"))
    return both.select(*cand.columns, "ref_id",
                       cosine_distance(vec_col, "_rv").alias("cos_dist"),
                       l2_distance(vec_col, "_rv").alias("l2_dist"))
