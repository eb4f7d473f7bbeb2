"""Centroid clustering of integer vectors by scalar lookup tables.

A component becomes an integer once. In every round a block of vectors tabulates, for each dimension, the squared
differences between the integer values that occur there and all centroids; a vector's distances are then gathered from
these tables and summed, without any multiplication per vector. All sums are exact integers, so a run gives the same
clusters however Spark deals the rows.

The vectors are written once. A round is one pass over them that leaves, per task, a count and a sum for each centroid and
dimension; only these (CENTROIDS * COMPONENTS rows) reach the driver, which holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import materialize
from trendloom.llm.vectors import lists, matrices, pieces, rows_of

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Vectors whose tables are made at a time.
BLOCK = 8192
#: The greatest integer component: 64 squared differences of such numbers still fit a long.
LARGEST = 1 << 27
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * component) of finite vectors."""
    found = np.floor(scale * vectors)
    if len(found) and np.abs(found).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // scale} has squared distances that fit no long")
    return found.astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) exact squared distances: one table a dimension, over the values that occur in it."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, place = np.unique(x[:, d], return_inverse=True)
        total += ((values[:, None] - centroids[None, :, d]) ** 2)[place]
    return total


def quantised(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """`vec_id, x array<int>` of the vectors with exactly so many components, none null or non-finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            for rows, vectors in matrices(part.column(1)):
                fine = np.isfinite(vectors).all(axis=1)
                if vectors.shape[1] == components and fine.any():
                    x = integers(vectors[fine], scale).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[fine])), lists(x)], ["vec_id", "x"])

    return rows_of(embeddings).mapInArrow(run, "vec_id long, x array<int>")


def _block(column: pa.Array) -> np.ndarray:
    [(_, x)] = matrices(column)
    return x.astype(np.int64)  # from doubles, which hold these integers exactly


def start(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash of seed and id, in that order (a null id last, then by components)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what is nearest to each; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for part in pieces(batches, BLOCK):
            x = _block(part.column(0))
            nearest = distances(x, centroids).argmin(axis=1)
            n += np.bincount(nearest, minlength=k)
            for c in np.unique(nearest):
                sums[c] += x[nearest == c].sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(held, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(held))),
            pa.array(np.repeat(n[held], dim)), pa.array(sums[held].ravel())], ["cluster", "dim", "n", "total"])

    parts = vectors.select("x").mapInArrow(run, "cluster int, dim int, n long, total long")
    new = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        new[r.cluster, r.dim] = int(r.total) // r.n
    return new


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`vec_id, cluster, distance`: the nearest centroid of every vector, of equally near ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            found = distances(_block(part.column(1)), centroids)
            nearest = found.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest.astype(np.int32)), pa.array(found[np.arange(len(found)), nearest])], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256` of every kept row of `embeddings(vec_id, embedding)`.

    Kept are vectors of `components` components, none of them null or non-finite. Rows that repeat an id or a vector are rows of
    their own; a null vec_id is kept, and starts a centroid only where there are fewer than k ids. With fewer than k vectors there
    are as many centroids. No kept vectors give no rows. Other columns are ignored. A component whose integer passes LARGEST, or
    an inertia that fits no long, raises an error.
    """
    vectors = materialize(quantised(embeddings, components, scale), "integers")
    centroids = start(vectors, k, seed)
    if not len(centroids):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = materialize(assigned(vectors, centroids), "assigned")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    return found.select(
        "vec_id", "cluster", "distance", of_cluster([sums.get(c, 0) for c in range(len(names))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of_cluster(names).alias("centroid_sha256"))
