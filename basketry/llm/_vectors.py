"""Arrow list columns as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles; None where it is null or empty, or holds a null or non-finite value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    use = present & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]])
    return [values[a:b] if ok else None for a, b, ok in zip(at[:-1], at[1:], use)]
