"""Vectors of Arrow list columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, lengths, components): the rows whose vector is neither null nor empty and
    has finite components only, and where those lie among all components, as doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    rows = np.flatnonzero((lengths > 0) & (bad[starts + lengths] == bad[starts]))
    return rows, starts[rows], lengths[rows], x


def padded(vectors: list[bytes], kind: str, width: int) -> np.ndarray:
    """Vectors of numbers of one kind as the rows of a matrix of doubles, with zeros behind."""
    out = np.zeros((len(vectors), width))
    for row, raw in zip(out, vectors):
        x = np.frombuffer(raw, kind)
        row[: len(x)] = x
    return out
