"""Embedding columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the lists of each length that are not null and hold finite numbers only."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    first = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = flat[first[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if good.any():
            yield at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest entry first, so that squares neither overflow nor vanish. Zero rows stay."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)
