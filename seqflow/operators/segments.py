"""Runs of rows with equal keys in sorted record batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def segment_bounds(t: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where the keys change, from 0 to the number of rows; null equals null."""
    change = np.zeros(len(t), bool)
    change[0] = True
    for k in keys:
        col = t[k].combine_chunks()
        here, before = col.slice(1), col.slice(0, len(t) - 1)
        moved = pc.or_(pc.fill_null(pc.not_equal(here, before), False),
                       pc.xor(pc.is_null(here), pc.is_null(before)))
        change[1:] |= moved.to_numpy(zero_copy_only=False)
    return [*np.flatnonzero(change).tolist(), len(t)]
