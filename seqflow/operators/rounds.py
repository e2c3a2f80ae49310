"""Which rows serve as reference in which round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def previous_round_reference(inputs: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Round 1 compares with the inputs, round r with the rows selected in r-1.

    Stored as a shift: the inputs count as the selection of round 0.
    """
    cols = inputs.columns
    first = inputs.select(*cols, F.lit(1).alias("round"))
    if selected is None:
        return first
    return first.unionByName(selected.select(*cols, (F.col("round") + 1).alias("round")))
