"""Greedy token-budget batches in arrival order.

Rows of a lane are packed first come, first served: a row that would lift the
open batch above the budget opens the next one. That is sequential by nature,
so rows are dealt by (lane, order) to parts of consecutive rows, many to a task where parts are small, and three steps are run:

1. per part, as a stream: for every possible fill level of the batch that is open
   when a lane enters the part, the fill level at its end and the number of batches
   opened. This is a step function with at most ``budget`` steps, and mostly very
   few, because chains from different starts soon meet. Functions of consecutive
   stretches compose into one, so a part of any length needs little memory.
2. per lane that spans several parts: a prefix scan over its functions as a tree.
   Going up, each task composes at most ``fan`` neighbours; going down, it hands each
   of them its entry state. The number of parts has no bound.
3. per part, as a stream: replay with the known entry state.

A lane holding most of the table is thus packed by many tasks, with the result
of a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.operators.ordered import join_on
from seqflow.operators.segments import segment_bounds
from seqflow.session import materialize

PART_ROWS = 1_000_000  # rows in a part, about; a part is streamed
TASK_ROWS = 50_000     # rows that one task cuts into parts, if these are smaller
FAN = 64               # functions that one task of the scan composes
_NAMES = ("froms", "exits", "opened")
_F = "froms array<bigint>, exits array<bigint>, opened array<bigint>"

Steps = tuple[list[int], list[int], list[int]]


def _chain_starts(prefix: np.ndarray, first: int, budget: int) -> list[int]:
    """Batch-opening rows from ``first`` on; ``prefix[i]`` is the size before row i."""
    starts = []
    n = len(prefix) - 1
    at = first
    while at < n:
        starts.append(at)
        at = int(np.searchsorted(prefix, prefix[at] + budget, side="right")) - 1
    return starts


def first_overflow(prefix: np.ndarray, used: int, budget: int) -> int:
    """First row that does not fit on top of ``used``; n if all fit."""
    return int(np.searchsorted(prefix, budget - used, side="right")) - 1


def transfer_steps(sizes: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int]]:
    """The chunk as a step function of the entry fill ``u``.

    Returns ``(from_used, exit_used, opened)``: the last step with
    ``from_used <= u`` applies. ``opened = 0`` marks the step on which all rows
    fit, where the exit fill is ``u + exit_used``.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(sizes)
    total = int(prefix[-1])
    # Rows that can overflow first: those whose running size reaches into the budget.
    firsts = np.unique(first_overflow_many(prefix, budget))
    rows = firsts[firsts < n]
    at, opened, end = rows.copy(), np.ones(len(rows), np.int64), rows.copy()
    live = np.arange(len(rows))
    while len(live):
        nxt = np.searchsorted(prefix, prefix[at[live]] + budget, side="right") - 1
        end[live] = at[live]
        going = nxt < n
        live = live[going]
        at[live] = nxt[going]
        opened[live] += 1
    froms, exits, counts = [], [], []
    if total <= budget:
        froms.append(0), exits.append(total), counts.append(0)
    # Row r overflows first for u in (budget - prefix[r+1], budget - prefix[r]].
    for r, e, c in sorted(zip(rows.tolist(), end.tolist(), opened.tolist()), reverse=True):
        start = max(0, budget - int(prefix[r + 1]) + 1)
        left = total - int(prefix[e])
        if counts and counts[-1] == c and exits[-1] == left and c > 0:
            continue
        froms.append(start), exits.append(left), counts.append(c)
    return froms, exits, counts


def first_overflow_many(prefix: np.ndarray, budget: int) -> np.ndarray:
    """First-overflow row for every entry fill 0..budget, without listing fills."""
    n = len(prefix) - 1
    lo = first_overflow(prefix, budget, budget)
    hi = first_overflow(prefix, 0, budget)
    rows = np.arange(lo, min(hi, n - 1) + 1)
    return rows[np.diff(prefix)[rows] > 0] if len(rows) else rows


def apply_steps(f: Steps, used: int) -> tuple[int, int]:
    """Fill of the open batch behind the rows of ``f``, and how many batches they opened."""
    froms, exits, opened = f
    i = int(np.searchsorted(froms, used, side="right")) - 1
    return (used + exits[i] if opened[i] == 0 else exits[i]), opened[i]


def compose_steps(f: Steps, g: Steps, budget: int) -> Steps:
    """The step function of rows ``f`` followed by rows ``g``."""
    froms, exits, opened = [], [], []

    def add(start: int, left: int, count: int) -> None:
        if not (count and opened and opened[-1] == count and exits[-1] == left):
            froms.append(start), exits.append(left), opened.append(count)

    for i, (start, left, count) in enumerate(zip(*f)):
        if count:
            end, more = apply_steps(g, left)
            add(start, end, count + more)
            continue
        # All rows of f fit: the fills from ``left`` on meet one step of g after another.
        last = f[0][i + 1] - 1 if i + 1 < len(f[0]) else budget - left
        lo, hi = (int(np.searchsorted(g[0], v, side="right")) - 1 for v in (start + left, last + left))
        for j in range(lo, hi + 1):
            add(max(start, g[0][j] - left), (left if not g[2][j] else 0) + g[1][j], g[2][j])
    return froms, exits, opened


def _lane_struct(by: Sequence[str]):
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def pack(rows: DataFrame, order: str, size: str, budget: int, by: Sequence[str] = (),
         carry: DataFrame | None = None, chunk_rows: int = PART_ROWS,
         max_chunks: int | None = None, fan: int = FAN) -> DataFrame:
    """``(by..., order, size, batch_no)``; rows above the budget are dropped.

    ``order`` is a unique integer within a lane. ``carry`` (``by..., used,
    batch_no``) continues batches left open by an earlier call. Parts have about ``chunk_rows`` rows;
    ``max_chunks`` bounds their number only if given.
    """
    return pack_with_state(rows, order, size, budget, by, carry, chunk_rows, max_chunks, fan)[0]


def pack_with_state(rows: DataFrame, order: str, size: str, budget: int, by: Sequence[str] = (),
                    carry: DataFrame | None = None, chunk_rows: int = PART_ROWS,
                    max_chunks: int | None = None, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """As ``pack``, plus the open batch of each lane after the last row."""
    by = list(by)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    lanes = "".join(f"`{c}` {fields[c]}, " for c in by)
    narrow = rows.select(_lane_struct(by).alias("_lane"), *by, F.col(order).cast("bigint").alias(order),
                         F.col(size).cast("bigint").alias(size))
    # Stored: ids and lengths only, so that the text is read once however many passes follow.
    narrow = materialize(narrow, "lengths").where(F.col(size) <= budget)
    count, cut = narrow.count(), chunk_rows
    tasks = max(1, -(-count // max(chunk_rows, TASK_ROWS)))
    if max_chunks is not None and count > max_chunks * chunk_rows:
        tasks, cut = max_chunks, None
    dealt = narrow.repartitionByRange(tasks, "_lane", order).withColumn("_task", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("_lane", order)
    tagged = materialize(dealt.mapInArrow(_summarize(size, budget, cut), f"_lane string, {lanes}`{order}` bigint, "
                                          f"`{size}` bigint, _task int, _nth int, {_F}"), "parts")
    # Parts are numbered in order; a task with fewer than the most leaves numbers out.
    most = (tagged.where("froms IS NOT NULL").agg(F.max("_nth")).first()[0] or 0) + 1
    parts = tasks * most
    tagged = tagged.withColumn("_part", F.expr(f"_task * {most} + _nth")).drop("_task", "_nth")
    functions = tagged.where("froms IS NOT NULL").select("_lane", *by, F.col("_part").alias("node"), "froms", "exits", "opened")
    if carry is None:
        starts = rows.sparkSession.createDataFrame([], "_lane string, used bigint, no bigint")
    else:
        starts = carry.select(_lane_struct(by).alias("_lane"), F.col("used").cast("bigint").alias("used"),
                              F.col("batch_no").cast("bigint").alias("no"))
    entries, ends = _scan(functions, starts, parts, budget, fan)
    entries = functions.select("_lane", *by, "node").join(entries, ["_lane", "node"])
    packed = _replay(tagged.where("froms IS NULL").drop("froms", "exits", "opened"), entries, by, order, size, budget, lanes)
    lane_names = functions.groupBy("_lane").agg(*[F.first(c).alias(c) for c in by], F.count(F.lit(1)).alias("_n"))
    state = lane_names.join(ends, "_lane").select(*by, "used", F.col("no").alias("batch_no"))
    return packed, state


def _summarize(size: str, budget: int, part_rows: int | None):
    """Rows, cut into parts of ``part_rows`` (if given) that count from ``_nth`` 0; behind a part's rows of a lane one row with their step function."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple[str, int], pa.Table, Steps] | None = None
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            nth = np.zeros(len(t), np.int32) if part_rows is None else ((seen + np.arange(len(t))) // part_rows).astype(np.int32)
            seen += len(t)
            t = t.append_column("_nth", pa.array(nth))
            sizes = t[size].to_numpy()
            closed = []
            bounds = segment_bounds(t, ["_lane", "_nth"])
            for a, e in zip(bounds, bounds[1:]):
                here, f = (t["_lane"][a].as_py(), int(nth[a])), transfer_steps(sizes[a:e], budget)
                if held is not None and held[0] == here:
                    held = (here, held[1], compose_steps(held[2], f, budget))
                    continue
                if held is not None:
                    closed.append(held[1:])
                held = (here, t.slice(a, 1), f)
            for name in _NAMES:
                t = t.append_column(name, pa.nulls(len(t), pa.list_(pa.int64())))
            yield from t.to_batches()
            yield from _function_rows(closed)
        if held is not None:
            yield from _function_rows([held[1:]])
    return run


def _function_rows(closed: list[tuple[pa.Table, Steps]]) -> Iterator[pa.RecordBatch]:
    if closed:
        out = pa.concat_tables([t for t, _ in closed])
        for k, name in enumerate(_NAMES):
            out = out.append_column(name, pa.array([f[k] for _, f in closed], pa.list_(pa.int64())))
        yield from out.combine_chunks().to_batches()


def _scan(functions: DataFrame, starts: DataFrame, parts: int, budget: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """``(_lane, node, used, no)`` at the entry of every part, and ``(_lane, used, no)`` behind the last one."""
    levels = [functions.select("_lane", "node", "froms", "exits", "opened")]
    nodes = parts
    while nodes > fan:
        up = levels[-1].withColumn("above", F.expr(f"node div {fan}")).groupBy("_lane", "above").applyInArrow(
            _compose_group(budget), f"_lane string, node int, {_F}")
        levels.append(materialize(up, "scan"))
        nodes = -(-nodes // fan)
    top = levels[-1]
    many = top.groupBy("_lane").agg(F.count(F.lit(1)).alias("_n"))
    entered = top.join(many, "_lane").join(starts, "_lane", "left").select(
        *top.columns, "_n", F.coalesce("used", F.lit(0)).alias("used0"), F.coalesce("no", F.lit(0)).alias("no0"))
    # A lane in one place needs no walk.
    step = F.size(F.filter("froms", lambda x: x <= F.col("used0")))
    at = lambda c: F.element_at(F.col(c), step)
    alone = entered.where("_n = 1")
    single = alone.select("_lane", "node", F.col("used0").alias("used"), F.col("no0").alias("no"), F.lit(False).alias("final")).unionByName(
        alone.select("_lane", "node", (F.when(at("opened") == 0, F.col("used0")).otherwise(0) + at("exits")).alias("used"),
                     (F.col("no0") + at("opened")).alias("no"), F.lit(True).alias("final")))
    walk_schema = "_lane string, node int, used bigint, no bigint, final boolean"
    walked = entered.where("_n > 1").groupBy("_lane").applyInArrow(_walk_group, walk_schema)
    states = materialize(single.unionByName(walked), "scan")
    entries, ends = states.where("NOT final").drop("final"), states.where("final").select("_lane", "used", "no")
    for level in reversed(levels[:-1]):
        above = entries.select("_lane", F.col("node").alias("above"), F.col("used").alias("used0"), F.col("no").alias("no0"))
        below = level.withColumn("above", F.expr(f"node div {fan}")).join(above, ["_lane", "above"])
        entries = materialize(below.groupBy("_lane", "above").applyInArrow(_walk_group, walk_schema).where("NOT final").drop("final"), "scan")
    return entries, ends


def _steps(t: pa.Table, i: int) -> Steps:
    return tuple(t[c][i].as_py() for c in ("froms", "exits", "opened"))


def _compose_group(budget: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        f = _steps(t, 0)
        for i in range(1, len(t)):
            f = compose_steps(f, _steps(t, i), budget)
        return pa.table({"_lane": t["_lane"].slice(0, 1), "node": t["above"].slice(0, 1).cast(pa.int32()),
                         **{c: pa.array([v], pa.list_(pa.int64())) for c, v in zip(("froms", "exits", "opened"), f)}})
    return run


def _walk_group(t: pa.Table) -> pa.Table:
    """At most ``fan`` neighbours in turn: each one's entry state, and the state behind the last."""
    t = t.sort_by("node")
    used, no = t["used0"][0].as_py(), t["no0"][0].as_py()
    states = []
    for i in range(len(t)):
        states.append((used, no))
        used, opened = apply_steps(_steps(t, i), used)
        no += opened
    states.append((used, no))
    body = pa.concat_tables([t, t.slice(len(t) - 1, 1)]).select(["_lane", "node"])
    return (body.append_column("used", pa.array([u for u, _ in states], pa.int64()))
            .append_column("no", pa.array([n for _, n in states], pa.int64()))
            .append_column("final", pa.array([False] * len(t) + [True])))


def _replay(rows: DataFrame, entries: DataFrame, by: list[str], order: str, size: str, budget: int, lanes: str) -> DataFrame:
    """Rows behind their lane's entry state, part by part, in one sorted stream."""
    none = F.lit(None).cast("bigint")
    stream = rows.select("_part", "_lane", *by, order, size, none.alias("used"), none.alias("no")).unionByName(
        entries.select(F.col("node").alias("_part"), "_lane", *by, none.alias(order), none.alias(size), "used", "no"))
    columns = [*by, order, size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = no = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            entry, entry_no = t["used"].to_pylist(), t["no"].to_pylist()
            sizes = t[size].fill_null(0).to_numpy()
            numbers = np.zeros(len(t), np.int64)
            bounds = segment_bounds(t, ["_part", "_lane"])
            for a, e in zip(bounds, bounds[1:]):
                if entry[a] is not None:
                    used, no = entry[a], entry_no[a]
                    a += 1
                if a == e:
                    continue
                prefix = np.concatenate([[0], np.cumsum(sizes[a:e])])
                opens = _chain_starts(prefix, first_overflow(prefix, used, budget), budget)
                flags = np.zeros(e - a, np.int64)
                flags[opens] = 1
                numbers[a:e] = no + np.cumsum(flags)
                no += len(opens)
                used = int(prefix[-1] - prefix[opens[-1]]) if opens else used + int(prefix[-1])
            kept = pa.array([x is None for x in entry])
            out = t.select(columns).append_column("batch_no", pa.array(numbers)).filter(kept)
            yield from out.to_batches()

    ordered = stream.repartition("_part").sortWithinPartitions("_part", "_lane", F.col("used").isNull(), order)
    return ordered.mapInArrow(run, f"{lanes}`{order}` bigint, `{size}` bigint, batch_no bigint")
