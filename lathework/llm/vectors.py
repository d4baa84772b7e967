"""What the operators on embeddings share: valid rows natively, and batches of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there, has entries, and none of them is null, NaN or infinite."""
    whole = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def element_type(df: DataFrame, vector: str) -> str:
    """float for float entries, else double: the type that entries are kept in."""
    return "float" if df.schema[vector].dataType.elementType.typeName() == "float" else "double"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of an Arrow column of lists, one after the other, and where each row's begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_size(column: pa.Array):
    """(rows, matrix) for each number of entries in the column."""
    values, offsets = flat(column)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[(offsets[rows][:, None] + np.arange(d)).reshape(-1)].reshape(len(rows), int(d))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = matrix.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = matrix.shape[1] * matrix.itemsize
    data = pa.py_buffer(np.ascontiguousarray(matrix))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32)), data])
