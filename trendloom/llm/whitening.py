"""Embedding whitening: integer vectors, exact covariance, leading components by contour integration.

Counts, sums and products are integers and exact, however Spark deals the rows: a block's products are taken in double precision only
where every partial sum is below 2^53. What reaches the driver has the size of the covariance, d * d numbers, whatever the
number of rows; `contour_eigen` finds the components there. Vectors are shuffled once, to find the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import materialize
from trendloom.llm.contour_eigen import leading
from trendloom.llm.vectors import lists, matrices, pieces, rows_of

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Vectors taken at once.
BLOCK = 4096
#: The greatest size of an entry: its integer is still exact as a double.
LARGEST = 1 << 45
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """Of the distinct vectors of one length: how many, their sums, components as columns over the roots of their eigenvalues, and shares of the trace."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: np.ndarray


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """`vec_id, x array<long>` with x = floor(SCALE * entry) + OFFSET, of vectors without null or non-finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            for rows, vectors in matrices(part.column(1)):
                fine = np.isfinite(vectors).all(axis=1)
                if not vectors.shape[1] or not fine.any():
                    continue
                if np.abs(vectors[fine]).max() > LARGEST:
                    raise ValueError(f"entries beyond {LARGEST} have no exact integer")
                x = np.floor(SCALE * vectors[fine]).astype(np.int64) + OFFSET
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[fine])), lists(x)], ["vec_id", "x"])

    return rows_of(embeddings).mapInArrow(run, "vec_id long, x array<long>")


def _blocks(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix for each length of a column without nulls."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    begin = np.cumsum(sizes) - sizes
    return [(rows := np.flatnonzero(sizes == d), flat[begin[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def gram(y: np.ndarray) -> np.ndarray:
    """Exact y'y, as Python integers."""
    total, top = np.zeros((y.shape[1], y.shape[1]), object), int(np.abs(y).max()) if y.size else 0
    step = (1 << 53) // max(top * top, 1)
    if step < 16:
        own = y.astype(object)
        return own.T @ own
    for at in range(0, len(y), step := min(step, BLOCK)):
        part = y[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _summed(fit: DataFrame, centres: dict[int, list[int]] | None) -> dict[int, dict[tuple[int, int], int]]:
    """By length: the exact sums of x per dimension, with their number at (-1, -1); or of products of x less its centre per pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for part in pieces(batches, BLOCK):
            for _, x in _blocks(part.column(0)):
                dim = x.shape[1]
                if centres is None:
                    held = totals.setdefault(dim, [0, np.zeros(dim, object)])
                    held[0] += len(x)
                    held[1] += x.sum(axis=0).astype(object)
                else:
                    held = totals.setdefault(dim, [0, np.zeros((dim, dim), object)])
                    held[1] += gram(x - np.array(centres[dim], np.int64))
        for dim, (n, total) in totals.items():
            if centres is None:
                i, j, values = [-1, *range(dim)], [-1] * (dim + 1), [n, *total]
            else:
                a, b = np.triu_indices(dim)
                i, j, values = a.tolist(), b.tolist(), total[a, b].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["dim", "i", "j", "total"])

    parts = fit.mapInArrow(run, "dim int, i int, j int, total decimal(38,0)")
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        found.setdefault(r.dim, {})[r.i, r.j] = int(r.total)
    return found


def covariances(fit: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """By length: number, sums and covariance (divisor n) of the vectors `fit(x)`.

    Rows are centred on the integers nearest their means before they are multiplied; what the rounding of the means leaves is taken
    off exactly, and each entry is rounded to a double once.
    """
    sums = {dim: (s[-1, -1], [s[i, -1] for i in range(dim)]) for dim, s in _summed(fit, None).items()}
    centres = {dim: [(2 * t + n) // (2 * n) for t in totals] for dim, (n, totals) in sums.items()}
    out = {}
    for dim, products in _summed(fit, centres).items():
        n, totals = sums[dim]
        rest = [t - n * c for t, c in zip(totals, centres[dim], strict=True)]
        v = np.zeros((dim, dim))
        for (i, j), p in products.items():
            v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
        out[dim] = n, totals, v
    return out


def models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length among the distinct vectors `fit(x)`."""
    out = {}
    for dim, (n, sums, v) in covariances(fit).items():
        values, vectors = leading(v, components)
        out[dim] = Model(n, sums, vectors / np.sqrt(values), values / np.trace(v) if len(values) else values)
    return out


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n * x - S, exactly; as Python integers where a long can't hold it."""
    sums = np.array(model.sums, object)
    bound = max(model.n * int(np.abs(x).max()), int(np.abs(sums).max())) if x.size else 0
    return model.n * x - sums.astype(np.int64) if bound < 1 << 62 else model.n * x.astype(object) - sums


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    return (centred(x, model) / model.n).astype(np.float64) @ model.scaled


def deviations(x: np.ndarray, model: Model) -> list[int]:
    """Exact squared distances from the mean, times n * n."""
    off = centred(x, model)
    if off.dtype != object and off.size and x.shape[1] * int(np.abs(off).max()) ** 2 >= 1 << 63:
        off = off.astype(object)
    return (off * off).sum(axis=1).tolist()


def identity_errors(fit: DataFrame, found: dict[int, Model]) -> dict[int, float]:
    """By length: the largest absolute entry of the whitened covariance less the identity, over the fit list (whose whitened mean is zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for part in pieces(batches, BLOCK):
            for _, x in _blocks(part.column(0)):
                w = whitened(x, found[x.shape[1]])
                totals[x.shape[1]] = totals.get(x.shape[1], 0.0) + w.T @ w
        for dim, total in totals.items():
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["dim", "i", "j", "total"])

    parts = fit.mapInArrow(run, "dim int, i int, j int, total double")
    out: dict[int, float] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():
        out[r.dim] = max(out.get(r.dim, 0.0), abs(r.total / found[r.dim].n - (r.i == r.j)))
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` of every usable row of `embeddings(vec_id, embedding)` and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. The fit list is each distinct integer vector once; rows that
    repeat an id or a vector, or have no id, are rows of their own. Vectors of each length are fitted apart. Directions that rounding
    can't tell from none have no component, so equal vectors alone, or a single one, give no rows; nor does an empty table.
    Tied eigenvalues leave the choice of their components open, but it is the same for all rows. Other columns are ignored. An entry
    beyond LARGEST, whose integer no double holds exactly, raises an error.
    """
    rows = materialize(integer_rows(embeddings), "integers")
    fit = materialize(rows.select("x").distinct(), "fit")
    found = models(fit, components)
    errors = identity_errors(fit, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            for own, x in _blocks(part.column(1)):
                model = found[x.shape[1]]
                m = len(model.explained)
                if not m:
                    continue
                each = pa.array(np.repeat(np.arange(len(own)), m))
                off = pa.array([Decimal(v) for v in deviations(x, model)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(own) * m, model.n, np.int64)), off.take(each), pa.array(whitened(x, model).ravel()),
                    pa.array(np.tile(model.explained, len(own))), pa.array(np.full(len(own) * m, errors[x.shape[1]]))], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return rows.mapInArrow(run, SCHEMA)
