"""What the vector operators share: matrices from list columns, usable vectors, exact scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double matrix of the vectors of each length; null lists are left out, null entries are NaN."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    own = np.maximum(sizes, 0)
    begin = np.cumsum(own) - own
    return [(rows := np.flatnonzero(sizes == d), flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes[sizes >= 0])]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors divided by powers of two, exactly, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    rows = scaled(vectors)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def rows_of(embeddings: DataFrame) -> DataFrame:
    """`vec_id long, vector` (array of float or double), whatever other columns there are."""
    kind = dict(embeddings.dtypes)["embedding"]
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def has_direction(vector: Column) -> Column:
    """Whether a vector is not null, empty or zero, and holds neither null nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel()))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
