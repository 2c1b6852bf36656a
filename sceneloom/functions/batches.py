"""Columns of Arrow batches as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def list_values(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of a column of lists one after another (nulls: NaN), where each list begins, and its length (-1: no list)."""
    many = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False), np.cumsum(np.maximum(many, 0)) - np.maximum(many, 0), many


def column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def plain(values, dtype=np.int64) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(dtype)


def within(n: np.ndarray) -> np.ndarray:
    """0 to n-1 for each n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
