"""Vectors in Arrow list columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def finite_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) for every width in a list column. Rows that are null or empty, or hold a null
    or non-finite component, are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    at = column.offsets.to_numpy().astype(np.int64)
    width = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        x = flat[at[rows][:, None] + np.arange(w)]
        good = np.isfinite(x).all(1)
        yield rows[good], x[good]


def scaled(x: np.ndarray, scale: int, most: float) -> np.ndarray:
    """floor(scale * x) in 64 bits. Finite components so large that the results of the integers would not fit in a long are an
    error."""
    whole = np.floor(x * scale)
    if len(x) and np.abs(whole).max() > most:
        raise ValueError(f"a component times {scale} is beyond {most:.0f}, where integer results do not fit in a long")
    return whole.astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """The rows of a matrix as bytes."""
    return [r.tobytes() for r in np.ascontiguousarray(x)]

