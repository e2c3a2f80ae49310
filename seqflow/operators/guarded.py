"""Result or error: one failing row or group does not end the job.

An envelope carries what a function returned or the message of what it raised.
Failed keys can be run again by themselves; what succeeded is not computed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.operators.ordered import join_on
from seqflow.session import materialize

ERROR = "error"
MESSAGE_LETTERS = 1000


def _message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:MESSAGE_LETTERS]


def guarded_rows(df: DataFrame, added: str, make_fn: Callable[[], Callable[[pa.Table], pa.Table]]) -> DataFrame:
    """``df`` with the ``added`` columns of a row-by-row function on batches, and ``error``.

    ``make_fn()`` is called once per task and returns a function from a table to a table of the added
    columns, row for row. Where it raises, the batch is halved until single rows fail: these get nulls
    and the message, all others their result. A function that cannot be made fails every row.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    probe = df.sparkSession.createDataFrame([], added).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, broken = None, None
        try:
            fn = make_fn()
        except Exception as e:  # reported with every row
            broken = _message(e)

        def parts(t: pa.Table) -> Iterator[pa.Table]:
            message = broken
            if message is None:
                try:
                    out = fn(t)
                    if len(out) != len(t):
                        raise ValueError(f"{len(out)} results for {len(t)} rows")
                    for f in probe:
                        t = t.append_column(f.name, out[f.name].cast(f.type))
                    yield t.append_column(ERROR, pa.nulls(len(t), pa.string()))
                    return
                except Exception as e:
                    message = _message(e)
            if broken is None and len(t) > 1:
                half = len(t) // 2
                yield from parts(t.slice(0, half))
                yield from parts(t.slice(half))
                return
            for f in probe:
                t = t.append_column(f.name, pa.nulls(len(t), f.type))
            yield t.append_column(ERROR, pa.array([message] * len(t), pa.string()))

        for b in batches:
            if b.num_rows:
                for t in parts(pa.Table.from_batches([b])):
                    yield from t.to_batches()

    return df.mapInArrow(run, f"{schema}, {added}, {ERROR} string")


def guarded_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table], added: str) -> DataFrame:
    """``keys..., added..., error``: the rows of ``fn(group)``, or one row with the message of a group that raised.

    A group is held whole in its task, as with any grouped function; use it on groups of bounded size.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    probe = df.sparkSession.createDataFrame([], added).toArrow().schema

    def run(t: pa.Table) -> pa.Table:
        head = t.slice(0, 1).select(keys)
        try:
            out = fn(t)
            cols = {k: pa.concat_arrays([head[k].combine_chunks()] * len(out)) if len(out) else head[k].slice(0, 0) for k in keys}
            return pa.table({**cols, **{f.name: out[f.name].cast(f.type) for f in probe}, ERROR: pa.nulls(len(out), pa.string())})
        except Exception as e:
            return pa.table({**{k: head[k] for k in keys}, **{f.name: pa.nulls(1, f.type) for f in probe}, ERROR: pa.array([_message(e)])})

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + f", {added}, {ERROR} string"
    return df.groupBy(*keys).applyInArrow(run, schema)


def with_reruns(inputs: DataFrame, keys: Sequence[str], run: Callable[[DataFrame], DataFrame], attempts: int = 2) -> DataFrame:
    """``run(inputs)``, whose failed keys are run again by themselves, up to ``attempts`` times in all.

    ``run`` returns rows with ``keys`` and ``error``. A key's rows are taken from its last attempt.
    Every attempt is stored, so a lost executor doesn't repeat an earlier one.
    """
    keys = list(keys)
    done = None
    left = inputs
    for attempt in range(1, attempts + 1):
        out = materialize(run(left).withColumn("attempt", F.lit(attempt)), "attempt")
        failed = materialize(out.where(F.col(ERROR).isNotNull()).select(*keys).distinct(), "failed-keys")
        if attempt == attempts or failed.isEmpty():
            return out if done is None else done.unionByName(out)
        good = join_on(out, failed, keys, "left_anti")
        done = good if done is None else done.unionByName(good)
        left = join_on(inputs, failed, keys, "left_semi")
    return done


def failed_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., n_failed, error``: keys with an error, the number of their failed rows and the smallest message."""
    bad = rows.where(F.col(ERROR).isNotNull())
    return bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_failed"), F.min(ERROR).alias(ERROR))
