"""Columns of vectors as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Integers up to this are exact as doubles.
EXACT = 2.0**53


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector without nulls and non-finite entries, and these vectors as doubles.

    Null and empty vectors take no part; vectors shorter than the longest of the batch are padded with zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())  # leaves out what lies under null rows
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.flatnonzero((sizes > 0) & (bad[begins + sizes] == bad[begins]))
    width = int(sizes[good].max()) if len(good) else 0
    if len(good) and (sizes[good] == width).all():
        return good, values[(begins[good][:, None] + np.arange(width)).ravel()].reshape(len(good), width)
    out = np.zeros((len(good), width))
    for row, i in enumerate(good.tolist()):
        out[row, : sizes[i]] = values[begins[i] : begins[i] + sizes[i]]
    return good, out


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as longs."""
    found = np.floor(vectors * scale)
    if found.size and np.abs(found).max() > EXACT:
        raise ValueError("a scaled component is beyond 2**53")
    return found.astype(np.int64)


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
