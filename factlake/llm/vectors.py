"""Reading of embedding columns for the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not empty and not zero, with finite components only."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    return rows.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")
    )


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix in double precision) for each dimension that occurs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)]))
    return out


def unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
