"""Betweenness centrality by level-synchronous shortest paths (Brandes 2001), from many pivots at a time.

A node is one row with a lane for each pivot: its distance from the pivot, the number of shortest paths, and the dependency of the pivot on it.
A level of the search is two steps for all pivots together. `_spread`: nodes of the frontier meet their edges, and what
their edges carry is summed per target. `_receive`: the sums meet the nodes' rows. Edges are packed once, by bucket of the node
they start from, and read again at every level; no row stands for a pair of pivot and node or of pivot and edge.

Dependencies have no lanes (empty bytes) before the way back begins, so the search outwards carries none.
What a task holds is bounded: the lanes of the NODES nodes of a bucket, and a part of PART edges (a bucket with more edges, as
one with a hub has, is cut into parts by target). Every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.storage import materialize

#: Pivots that are searched from together.
LANES = 256
#: Nodes of a bucket, about.
NODES = 2048
#: Edges of a packed part, about, and edges whose lanes are gathered at once.
PART, CHUNK = 1 << 16, 4096
STATE = "bucket int, id long, dist binary, sigma binary, dep binary, fresh int"
SENT = "bucket int, id long, lanes binary"


def pivots(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """The k nodes with the smallest md5 of name and seed."""
    return nodes.orderBy(F.md5(F.concat(F.col("node"), F.lit(str(seed)))), "node").limit(k)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches with equal numbers in the first columns."""
    for batch in batches:
        if batch.num_rows:
            marks = np.stack([batch.column(c).to_numpy() for c in range(columns)], axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                yield tuple(marks[a].tolist()), batch.slice(a, b - a)


def _lanes(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length (which may be none), as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix)])


class Adjacency(NamedTuple):
    """`edges(bucket, part, sources, targets)`: packed edges by bucket of their source, targets in order; `parts(bucket, part)`."""

    edges: DataFrame
    parts: DataFrame


def _adjacency(edges: DataFrame, source: str, target: str, buckets: int) -> Adjacency:
    own = edges.select(F.pmod(source, F.lit(buckets)).cast("int").alias("bucket"), F.col(source).alias("source"), F.col(target).alias("target"))
    sizes = own.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("n"))
    dealt = own.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("target"), F.col("n")).cast("int").alias("part"), "source", "target")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sources, targets = (whole.column(c).to_numpy() for c in (2, 3))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([sources.tobytes()]), pa.array([targets.tobytes()])], ["bucket", "part", "sources", "targets"])

        for now, run in _runs(batches, 2):
            if held and (now != key or sum(x.num_rows for x in held) >= PART):
                yield row()
                held.clear()
            key = now
            held.append(run)
        if held:
            yield row()

    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "target")
    packed = materialize(dealt.mapInArrow(pack, "bucket int, part int, sources binary, targets binary"), "adjacency")
    return Adjacency(packed, packed.select("bucket", "part").distinct())


def _frontier(state: DataFrame, lanes_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """What nodes send along their edges, where a lane isn't zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NODES):
                part = batch.slice(at, NODES)
                sent = lanes_of(_lanes(part.column(2), np.int32), _lanes(part.column(3), np.float64), _lanes(part.column(4), np.float64))
                on = np.flatnonzero(sent.any(axis=1))
                if len(on):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), part.column(1).take(pa.array(on)), _packed(sent[on])], ["bucket", "id", "lanes"])

    return state.mapInArrow(run, SENT)


def _spread(sent: DataFrame, along: Adjacency, buckets: int) -> DataFrame:
    """The lanes that come to each target, summed over the edges of a part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, matrix = None, [], [], None
        for (bucket, part, side), own in _runs(batches, 3):
            if (bucket, part) != key:
                key, ids, rows, matrix = (bucket, part), [], [], None
            if side == 0:
                ids.append(own.column(3).to_numpy())
                rows.append(_lanes(own.column(4), np.float64))
                continue
            if not ids:
                continue
            if matrix is None:
                names = np.concatenate(ids)
                order = np.argsort(names)
                names, matrix = names[order], np.concatenate(rows)[order]
            for sources, targets in zip(own.column(4).to_pylist(), own.column(5).to_pylist(), strict=True):
                sources, targets = np.frombuffer(sources, np.int64), np.frombuffer(targets, np.int64)
                place = np.minimum(np.searchsorted(names, sources), len(names) - 1)
                on = names[place] == sources
                place, targets = place[on], targets[on]
                for at in range(0, len(targets), CHUNK):
                    own_targets = targets[at : at + CHUNK]
                    first = np.flatnonzero(np.append(True, own_targets[1:] != own_targets[:-1]))
                    sums = np.add.reduceat(matrix[place[at : at + CHUNK]], first, axis=0)
                    to = own_targets[first]
                    yield pa.RecordBatch.from_arrays([pa.array((to % buckets).astype(np.int32)), pa.array(to), _packed(sums)], ["bucket", "id", "lanes"])

    none = F.lit(None).cast("binary")
    left = sent.join(along.parts, "bucket").select("bucket", "part", F.lit(0).alias("side"), "id", F.col("lanes").alias("a"), none.alias("b"))
    right = along.edges.select("bucket", "part", F.lit(1).alias("side"), F.lit(0).cast("long").alias("id"), F.col("sources").alias("a"), F.col("targets").alias("b"))
    both = left.union(right).repartition(_tasks(sent, buckets), "bucket", "part").sortWithinPartitions("bucket", "part", "side")
    return both.mapInArrow(run, SENT)


def _receive(state: DataFrame, sums: DataFrame, buckets: int, update: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The nodes' rows after `update(dist, sigma, dep, sum)`, which changes them in place, gives the dependencies and counts what it set in each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, table = None, [], [], None

        def whole() -> list[np.ndarray]:
            names = np.concatenate(ids)
            order = np.argsort(names)
            dist, sigma, dep = (np.concatenate(x)[order] for x in zip(*parts, strict=True))
            return [names[order], dist, sigma, dep, np.zeros(sigma.shape)]

        def rows(bucket: int, table: list[np.ndarray]) -> pa.RecordBatch:
            names, dist, sigma, dep, come = table
            dep, fresh = update(dist, sigma, dep, come)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), bucket, np.int32)), pa.array(names), _packed(dist), _packed(sigma), _packed(dep), pa.array(fresh.astype(np.int32))], [c.split()[0] for c in STATE.split(", ")])

        for (bucket, side), own in _runs(batches, 2):
            if bucket != key:
                if ids:
                    yield rows(key, table or whole())
                key, ids, parts, table = bucket, [], [], None
            if side == 0:
                ids.append(own.column(2).to_numpy())
                parts.append((_lanes(own.column(3), np.int32), _lanes(own.column(4), np.float64), _lanes(own.column(5), np.float64)))
                continue
            table = table or whole()
            to = np.searchsorted(table[0], own.column(2).to_numpy())
            order = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.diff(to[order], prepend=-1))
            table[4][to[order][first]] += np.add.reduceat(_lanes(own.column(3), np.float64)[order], first, axis=0)
        if ids:
            yield rows(key, table or whole())

    none = F.lit(None).cast("binary")
    left = state.select("bucket", F.lit(0).alias("side"), "id", "dist", "sigma", "dep")
    right = sums.select("bucket", F.lit(1).alias("side"), "id", F.col("lanes").alias("dist"), none.alias("sigma"), none.alias("dep"))
    both = left.union(right).repartition(_tasks(state, buckets), "bucket").sortWithinPartitions("bucket", "side")
    return both.mapInArrow(run, STATE)


def _tasks(df: DataFrame, buckets: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, 10_000))


def _started(nodes: DataFrame, lanes: dict[int, int], width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NODES):
                ids = batch.column(0).slice(at, NODES).to_numpy()
                dist, sigma, dep = np.full((len(ids), width), -1, np.int32), np.zeros((len(ids), width)), np.zeros((len(ids), 0))
                fresh = np.zeros(len(ids), np.int32)
                for row, i in enumerate(ids.tolist()):
                    if (lane := lanes.get(i)) is not None:
                        dist[row, lane], sigma[row, lane], fresh[row] = 0, 1.0, 1
                yield pa.RecordBatch.from_arrays([pa.array((ids % buckets).astype(np.int32)), pa.array(ids), _packed(dist), _packed(sigma), _packed(dep), pa.array(fresh)], [c.split()[0] for c in STATE.split(", ")])

    return nodes.select("id").mapInArrow(run, STATE)


def _whole_lanes(dep: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The dependencies, zeros if they have no lanes yet."""
    return dep if dep.shape == sigma.shape else np.zeros(sigma.shape)


def _forward(level: int) -> Callable:
    def update(dist: np.ndarray, sigma: np.ndarray, dep: np.ndarray, come: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = (come > 0) & (dist < 0)
        dist[new], sigma[new] = level, come[new]
        return dep, new.sum(axis=1)

    return update


def _backward(level: int) -> Callable:
    def update(dist: np.ndarray, sigma: np.ndarray, dep: np.ndarray, come: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = dist == level
        dep = _whole_lanes(dep, sigma)
        dep[at] = sigma[at] * come[at]
        return dep, at.sum(axis=1)

    return update


def _dependencies(nodes: DataFrame, out: Adjacency, back: Adjacency, chosen: list[int], buckets: int) -> DataFrame:
    """`id, dep`: the dependencies of these pivots on each node, summed; that of a pivot on itself is left out."""
    state = materialize(_started(nodes, {i: lane for lane, i in enumerate(chosen)}, len(chosen), buckets), "level")
    depth = 0
    while True:
        ahead = _frontier(state.where("fresh > 0"), lambda dist, sigma, dep, at=depth: np.where(dist == at, sigma, 0.0))
        after = materialize(_receive(state, _spread(ahead, out, buckets), buckets, _forward(depth + 1)), "level")
        if not after.agg(F.sum("fresh").alias("n")).first()["n"]:
            break
        state, depth = after, depth + 1
    for level in range(depth, 1, -1):  # what pivots themselves receive isn't asked for
        below = _frontier(state, lambda dist, sigma, dep, at=level: np.where(dist == at, (1 + _whole_lanes(dep, sigma)) / np.where(sigma > 0, sigma, 1.0), 0.0))
        state = materialize(_receive(state, _spread(below, back, buckets), buckets, _backward(level - 1)), "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lanes(batch.column(1), np.float64).sum(axis=1))], ["id", "dep"])

    return state.select("id", "dep").mapInArrow(run, "id long, dep double")


def betweenness(edges: DataFrame, k_samples: int = 200, top_n: int | None = 200, seed: int = 42, lanes: int = LANES, bucket_nodes: int = NODES) -> DataFrame:
    """`concept_name, centrality_score, graph_node_count, graph_edge_count` of the directed graph `edges(src, dst)`.

    Shortest paths run from k = min(k_samples, n) pivots, `lanes` of them at a time. A node's dependency sum leaves out itself as a
    pivot and is divided by (pivots other than itself) * (n - 2). An empty graph gives no rows. A level moves each node's row and what the
    frontier sends, `lanes` numbers each, and the packed edges; loops and repeated edges count for nothing, null ends are left out.
    """
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "graph")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")  # which fixes the numbers
    n, m = nodes.count(), edges.count()
    buckets = max(1, -(-n // bucket_nodes))
    k = min(k_samples, n)
    chosen = [r.id for r in pivots(nodes, k, seed).collect()]  # k_samples at most
    of = {end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")) for end in ("src", "dst")}
    numbered = materialize(edges.join(of["src"], "src").join(of["dst"], "dst").select("src_id", "dst_id"), "numbered")
    total = nodes.select("id", F.lit(0.0).alias("dep")).limit(0)
    if chosen:
        out, back = _adjacency(numbered, "src_id", "dst_id", buckets), _adjacency(numbered, "dst_id", "src_id", buckets)
        for at in range(0, len(chosen), lanes):
            total = total.union(_dependencies(nodes, out, back, chosen[at : at + lanes], buckets))
    total = total.groupBy("id").agg(F.sum("dep").alias("dep"))
    others = F.lit(k) - F.when(F.col("id").isin(chosen), 1).otherwise(0)
    scored = nodes.join(total, "id", "left").select(
        F.col("node").alias("concept_name"),
        F.when((others > 0) & F.lit(n > 2), F.coalesce("dep", F.lit(0.0)) / (others * F.lit(float(max(n - 2, 1))))).otherwise(0.0).alias("centrality_score"),
        F.lit(n).cast("long").alias("graph_node_count"), F.lit(m).cast("long").alias("graph_edge_count"))
    return scored if top_n is None else scored.orderBy(F.desc("centrality_score"), "concept_name").limit(top_n)
