"""Approximate nearest neighbours by low-dimensional stable projections, indexed by a kd-tree (SRS, Sun et al. 2014).

Unit vectors are projected on PROJECTIONS Gaussian directions. If two vectors lie at distance d, the square of their projected
distance over d^2 follows a chi-square law with PROJECTIONS degrees of freedom. So projected neighbours are verified from
near to far, and when the next one lies beyond d * sqrt(q), with d the distance of the k-th best verified so far and q the
law's CONFIDENCE quantile, a vector nearer than d is missed with a probability of 1 - CONFIDENCE at most: the search stops.

The upper levels of the kd-tree are fitted on a sample of about SAMPLE vectors. Where more than CELL vectors lie in one of their
leaves (a dense region, or a large table), tasks fit levels below it on a sample of its own vectors, so that a query needn't visit all
of it. What is a leaf then is a cell, and every vector is indexed in its cell. Cells that are too large even so (MOST_CELLS are reached,
or projections are equal) are cut into parts by hash. The lowest levels are built in the task that holds a part, down to
buckets of BUCKET vectors, which a query visits in the order of their distance from it. Queries
go to their own cell first; the k-th best there bounds the distance, and so the cells that the stopping test leaves to visit in a second
step. A part's vectors are held in memory (CELL at most) while its queries stream past; those of a part with very many queries
are dealt over copies of it.

Equal vectors are one class with the smallest ids of its rows, and queries on equal vectors are one search.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize
from trendloom.llm.vectors import has_direction, lists, matrices, pieces, rows_of, scaled, unit

PROJECTIONS = 12
CONFIDENCE = 0.95
TOP = 5
#: A row asks if its vec_id is divisible by this.
EVERY = 50
#: The upper tree, and the tree below each of its leaves, is fitted on about so many vectors at most, EACH for a leaf.
SAMPLE = 1 << 16
EACH = 32
CELL = 4096
#: Cells that trees below leaves give in all; their boxes, 200 bytes a cell, go to every task that deals queries.
MOST_CELLS = 1 << 16
#: Coordinates of queries and boxes that are compared at once when queries are dealt to cells.
COMPARED = 1 << 21
BUCKET = 128
#: Queries of a part of a cell that one task answers.
QUERIES = 8192
BLOCK = 2048
SEED = 41
#: Rows that a task of dealt queries passes on at a time.
ROUTED = 1 << 14
#: Tasks of a step at most, however many parts there are.
MOST_TASKS = 20_000
#: Rounding that squared distances may differ by.
SLACK = 1e-12


def quantile(confidence: float, degrees: int) -> float:
    """Of the chi-square law with an even number of degrees of freedom, whose distribution function is a finite sum."""
    def distribution(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while distribution(high) < confidence:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if distribution(middle) < confidence else (low, middle)
    return high


REACH = quantile(CONFIDENCE, PROJECTIONS)


@functools.lru_cache(8)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


class Tree(NamedTuple):
    """Of each node: the projection it cuts and where, and the place of its first half, which the second follows; -1 for a leaf. A leaf's place is its cell's number."""

    along: np.ndarray
    cut: np.ndarray
    below: np.ndarray

    def cells(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        while len(rows := np.flatnonzero(self.below[node] >= 0)):
            at = node[rows]
            node[rows] = self.below[at] + (projected[rows, self.along[at]] > self.cut[at])
        return node

    def grown(self, trees: dict[int, Tree]) -> Tree:
        """With a tree in the place of each of these leaves."""
        along, cut, below = [self.along.copy()], [self.cut.copy()], [self.below.copy()]
        end = len(self.below)
        for leaf, tree in sorted(trees.items()):
            moved = np.where(tree.below >= 0, tree.below + end - 1, -1)
            along[0][leaf], cut[0][leaf], below[0][leaf] = tree.along[0], tree.cut[0], moved[0]
            along.append(tree.along[1:])
            cut.append(tree.cut[1:])
            below.append(moved[1:])
            end += len(tree.below) - 1
        return Tree(np.concatenate(along), np.concatenate(cut), np.concatenate(below))


def fitted(sample: np.ndarray, levels: int) -> Tree:
    """Cuts the sample at the median of its widest projection, level by level."""
    inner = (1 << levels) - 1
    along, cut, parts = np.zeros(2 * inner + 1, np.int64), np.zeros(2 * inner + 1), [sample]
    for node in range(inner):
        part = parts[node]
        if len(part):
            along[node] = np.ptp(part, axis=0).argmax()
            cut[node] = np.median(part[:, along[node]])
        low = part[:, along[node]] <= cut[node]
        parts += [part[low], part[~low]]
        parts[node] = None
    node = np.arange(2 * inner + 1)
    return Tree(along, cut, np.where(node < inner, 2 * node + 1, -1))


def gap(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(points, boxes) squared distances of points from boxes."""
    off = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0.0)
    return (off * off).sum(axis=2)


class Part:
    """Vectors of one length in a part of a cell, in buckets of a kd-tree."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], own: np.ndarray) -> None:
        points = unit(vectors)
        projected = points @ directions(vectors.shape[1])
        buckets: list[np.ndarray] = []
        open_ = [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            if len(rows) <= BUCKET:
                buckets.append(rows)
                continue
            axis = np.ptp(projected[rows], axis=0).argmax()
            order = rows[np.argpartition(projected[rows, axis], len(rows) // 2)]
            open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        order = np.concatenate(buckets)
        self.ends = np.cumsum([0, *map(len, buckets)])
        self.points, self.projected, self.vectors = points[order], projected[order], vectors[order]
        self.ids, self.own = [ids[i] for i in order], own[order]
        self.copies = np.array([len(x) for x in self.ids], np.int64)
        self.low = np.array([projected[b].min(axis=0) for b in buckets])
        self.high = np.array([projected[b].max(axis=0) for b in buckets])

    def nearest(self, point: np.ndarray, projected: np.ndarray, k: int, bound: float) -> np.ndarray:
        """The places of the k nearest rows' classes that the stopping test lets pass; `bound` is a squared distance known to hold k rows."""
        found, far = np.zeros(0, np.int64), np.zeros(0)
        gaps = gap(self.low, self.high, projected[None])[0]
        for b in np.argsort(gaps, kind="stable").tolist():
            if gaps[b] > bound * REACH + SLACK:
                break
            rows = np.arange(self.ends[b], self.ends[b + 1])
            off = self.projected[rows] - projected
            rows = rows[(off * off).sum(axis=1) <= bound * REACH + SLACK]
            if not len(rows):
                continue
            away = np.maximum(2 - 2 * (self.points[rows] @ point), 0.0)
            on = away <= bound + SLACK
            found, far = np.concatenate((found, rows[on])), np.concatenate((far, away[on]))
            order = np.argsort(far, kind="stable")
            held = np.cumsum(self.copies[found[order]])
            if len(held) and held[-1] >= k:
                bound = min(bound, far[order[np.searchsorted(held, k)]])
                on = far <= bound + SLACK
                found, far = found[on], far[on]
        return found

    def answer(self, vector: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, exact cosines and classes of the k nearest rows of these classes, ties by id."""
        q, v = scaled(vector[None])[0], scaled(self.vectors[places])
        score = (v * q).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (q * q).sum())
        ids = np.concatenate([np.zeros(0, np.int64), *(self.ids[i] for i in places.tolist())])
        score, own = np.repeat(score, self.copies[places]), np.repeat(self.own[places], self.copies[places])
        order = np.lexsort((own, ids, -score))[:k]
        return ids[order], score[order], own[order]


def classes(embeddings: DataFrame, k: int, every: int) -> DataFrame:
    """`cid, ids, asks, vector`: one row per distinct usable vector with a number, the ids of its k rows of smallest id, and whether a row of it asks.

    The windows keep k rows a task already, so a vector of very many rows meets few of them.
    """
    rows = rows_of(embeddings).where(F.col("vec_id").isNotNull() & has_direction(F.col("vector")))
    order = Window.partitionBy("vector", "ask").orderBy("vec_id")
    few = rows.withColumn("ask", F.col("vec_id") % every == 0).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k)
    return few.groupBy("vector").agg(ids.alias("ids"), F.bool_or("ask").alias("asks")).select(F.monotonically_increasing_id().alias("cid"), "ids", "asks", "vector")


def _projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and projections of a column of vectors."""
    parts = [(rows, unit(vectors) @ directions(vectors.shape[1])) for rows, vectors in matrices(column)]
    return np.concatenate([rows for rows, _ in parts]), np.concatenate([p for _, p in parts])


def sampled(found: DataFrame, n: int, size: int) -> np.ndarray:
    """Projections of about `size` of n classes, those of small hash."""
    kept = found.where(F.pmod(F.xxhash64("vector", F.lit(SEED)), F.lit(n)) < size).select("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            _, projected = _projected(part.column(0))
            yield pa.RecordBatch.from_arrays([lists(projected)], ["p"])

    rows = kept.mapInArrow(run, "p array<double>").collect()
    return np.array([r.p for r in rows], np.float64).reshape(-1, PROJECTIONS)


def indexed(found: DataFrame, tree: Tree) -> DataFrame:
    """`found` with the cell of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            rows, projected = _projected(part.column(3))
            own = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(tree.cells(projected).astype(np.int32)), *own.columns], ["cell", *own.schema.names])

    return found.mapInArrow(run, f"cell int, cid long, ids array<long>, asks boolean, vector {dict(found.dtypes)['vector']}")


def lower_levels(sizes: dict[int, int], cell_size: int, sample: int, most: int) -> dict[int, int]:
    """How many levels each leaf of more than `cell_size` vectors needs below it, as far as `most` cells in all and `sample` vectors a leaf go."""
    levels = {leaf: min(math.ceil(math.log2(n / cell_size)), int(math.log2(max(sample // EACH, 1)))) for leaf, n in sizes.items() if n > cell_size}
    while sum(1 << v for v in levels.values()) > most and max(levels.values()) > 0:
        top = max(levels.values())
        levels = {leaf: v - (v == top) for leaf, v in levels.items()}
    return {leaf: v for leaf, v in levels.items() if v > 0}


def lower_trees(index: DataFrame, sizes: dict[int, int], levels: dict[int, int]) -> dict[int, Tree]:
    """The trees below these leaves, each fitted in a task of its own on about EACH of the leaf's vectors, by hash, for each of its leaves."""
    whole = 1 << 30
    shares = [(leaf, v, min(whole, math.ceil(whole * (EACH << v) / sizes[leaf]))) for leaf, v in levels.items()]
    wanted = F.broadcast(index.sparkSession.createDataFrame(shares, "cell int, levels int, share long"))  # leaves of the upper tree at most
    kept = index.join(wanted, "cell").where(F.pmod(F.xxhash64("vector", F.lit(SEED + 1)), F.lit(whole)) < F.col("share")).select("cell", "levels", "vector")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            rows, projected = _projected(part.column(2))
            own = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), lists(projected)], ["cell", "levels", "p"])

    def fit(part: pa.Table) -> pa.Table:
        tree = fitted(np.concatenate([p for _, p in matrices(part.column("p").combine_chunks())]), part.column("levels")[0].as_py())
        return pa.table({"cell": part.column("cell")[:1], "along": lists(tree.along.astype(np.int32)[None]), "cut": lists(tree.cut[None]), "below": lists(tree.below.astype(np.int32)[None])})

    found = kept.mapInArrow(project, "cell int, levels int, p array<double>").groupBy("cell").applyInArrow(fit, "cell int, along array<int>, cut array<double>, below array<int>")
    return {r.cell: Tree(np.array(r.along, np.int64), np.array(r.cut), np.array(r.below, np.int64)) for r in found.collect()}


class Boxes(NamedTuple):
    """Of each cell that holds vectors: its number, how many parts it has, and the box around its projections."""

    cell: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def boxes(index: DataFrame, cell_size: int) -> Boxes:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            rows, projected = _projected(part.column(1))
            cell = part.column(0).to_numpy()[rows]
            order = np.argsort(cell, kind="stable")
            begin = np.flatnonzero(np.diff(cell[order], prepend=-1))
            m = len(begin)
            low, high = np.minimum.reduceat(projected[order], begin), np.maximum.reduceat(projected[order], begin)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(cell[order][begin], PROJECTIONS)), pa.array(np.tile(np.arange(PROJECTIONS, dtype=np.int32), m)),
                pa.array(np.repeat(np.diff(begin, append=len(cell)), PROJECTIONS)), pa.array(low.ravel()), pa.array(high.ravel())], ["cell", "axis", "n", "low", "high"])

    each = index.select("cell", "vector").mapInArrow(run, "cell int, axis int, n long, low double, high double")
    rows = each.groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    rows.sort(key=lambda r: (r.cell, r.axis))
    first = rows[::PROJECTIONS]
    shape = (len(first), PROJECTIONS)
    return Boxes(np.array([r.cell for r in first], np.int64), np.array([-(-r.n // cell_size) for r in first], np.int64),
                 np.array([r.low for r in rows]).reshape(shape), np.array([r.high for r in rows]).reshape(shape))


def _answers(index: DataFrame, asked: DataFrame, k: int, queries: int, tasks: int) -> DataFrame:
    """`cid, vector, found array<struct<vec_id, score, own>>` (own: the row's class) for each row of `asked(cell, part, cid, vector, bound)`, from the part of the cell that it names."""
    kind = dict(index.dtypes)["vector"]
    crowd = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / queries).cast("int").alias("shares"))
    mine = index.join(crowd, ["cell", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(
        "cell", "part", "share", F.lit(0).alias("side"), "cid", "vector", "ids", F.lit(None).cast("double").alias("bound"))
    theirs = asked.join(crowd, ["cell", "part"]).withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares")).cast("int")).select(
        "cell", "part", "share", F.lit(1).alias("side"), "cid", "vector", F.lit(None).cast("array<long>").alias("ids"), "bound")
    key = ["cell", "part", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name, parts = None, None

        def built() -> dict[int, Part]:
            if not held:
                return {}
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids, cid = whole.column(6).to_pylist(), whole.column(4).to_numpy()
            return {v.shape[1]: Part(v, [np.array(ids[i], np.int64) for i in rows], cid[rows]) for rows, v in matrices(whole.column(5))}

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            edges = [0, *(np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                own = tuple(marks[a, :3].tolist())
                if own != name:
                    name, parts = own, None
                    held.clear()
                if marks[a, 3] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                for some in pieces(iter([batch.slice(a, b - a)]), BLOCK):
                    parts = built() if parts is None else parts
                    bounds, answers = some.column(7).to_numpy(zero_copy_only=False), [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * some.num_rows
                    for rows, vectors in matrices(some.column(5)):
                        if (there := parts.get(vectors.shape[1])) is None:
                            continue
                        points = unit(vectors)
                        projected = points @ directions(vectors.shape[1])
                        for i, row in enumerate(rows.tolist()):
                            answers[row] = there.answer(vectors[i], there.nearest(points[i], projected[i], k, bounds[row]), k)
                    ends = pa.array(np.cumsum([0, *(len(x[0]) for x in answers)]).astype(np.int32))
                    fields = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*answers, strict=True)], ["vec_id", "score", "own"])
                    yield pa.RecordBatch.from_arrays([some.column(4), some.column(5), pa.ListArray.from_arrays(ends, fields)], ["cid", "vector", "found"])

    groups = mine.unionByName(theirs).repartition(tasks, *key).sortWithinPartitions(*key, "side")
    return groups.mapInArrow(run, f"cid long, vector {kind}, found array<struct<vec_id:bigint,score:double,own:bigint>>")


def _routed(df: DataFrame, tree: Tree, around: Boxes, k: int, first: bool) -> DataFrame:
    """`cell, part, cid, vector, bound`: where each query goes. First the first part of its own cell; then, with the k-th best from there, whatever the stopping test leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, BLOCK):
            rows, projected = _projected(part.column(1))
            own = tree.cells(projected)
            if first:
                which = np.arange(len(rows))
                yield routed(part, rows, which, own, np.zeros(len(rows), np.int64), np.full(len(rows), np.inf))
                continue
            scores = [part.column(2)[i].as_py() for i in rows.tolist()]
            limit = np.array([max(0.0, 2 - 2 * s[k - 1]["score"]) + SLACK if len(s) >= k else np.inf for s in scores])
            step = max(1, COMPARED // around.low.size)
            for at in range(0, len(rows), step):
                some = slice(at, at + step)
                reached = gap(around.low, around.high, projected[some]) <= (limit[some] * REACH + SLACK)[:, None]
                q, c = np.nonzero(reached)
                each = around.parts[c]
                which, cells = np.repeat(q + at, each), np.repeat(around.cell[c], each)
                cut = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
                keep = (cells != own[which]) | (cut > 0)
                which, cells, cut = which[keep], cells[keep], cut[keep]
                for low in range(0, len(which), ROUTED):
                    few = slice(low, low + ROUTED)
                    yield routed(part, rows, which[few], cells[few], cut[few], limit[which[few]])

    def routed(part: pa.RecordBatch, rows: np.ndarray, which: np.ndarray, cells: np.ndarray, cut: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        whose = pa.array(rows[which])
        return pa.RecordBatch.from_arrays([
            pa.array(cells.astype(np.int32)), pa.array(cut.astype(np.int32)), part.column(0).take(whose), part.column(1).take(whose), pa.array(bounds)], ["cell", "part", "cid", "vector", "bound"])

    return df.mapInArrow(run, f"cell int, part int, cid long, vector {dict(df.dtypes)['vector']}, bound double")


def nearest(embeddings: DataFrame, top: int = TOP, every: int = EVERY, cell_size: int = CELL, sample: int = SAMPLE, queries: int = QUERIES, most_cells: int = MOST_CELLS) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row of `embeddings(vec_id, embedding)` whose id is divisible by `every`, the `top` rows of greatest cosine found.

    Candidates are all other rows; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; vectors of another length than the query's aren't compared with it. Rows that repeat an id,
    or an id and its vector, are rows of their own: each asks, and each may be found by the others. No query, or no candidate, gives
    no rows. Other columns are ignored.
    """
    k = top + 1  # the query's own row is among its class's
    found = materialize(classes(embeddings, k, every), "classes")  # which fixes the numbers
    n = found.count()
    levels = max(0, min(math.ceil(math.log2(max(n, 1) / cell_size)), int(math.log2(max(sample // EACH, 1)))))
    tree = fitted(sampled(found, max(n, 1), sample), levels)
    index = indexed(found, tree)
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()} if levels else {}
    if below := lower_levels(sizes, cell_size, sample, most_cells):
        tree = tree.grown(lower_trees(index, sizes, below))
    index = materialize(indexed(found, tree), "index")
    around = boxes(index, cell_size)
    if not len(around.cell):
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = embeddings.sparkSession.createDataFrame([(int(c), int(p)) for c, p in zip(around.cell, around.parts, strict=True)], "cell int, parts int")
    index = index.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")).drop("parts")  # a row a cell
    tasks = max(int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * int(around.parts.sum()), MOST_TASKS))
    asked = found.where("asks").select("cid", "vector")
    near = materialize(_answers(index, _routed(asked, tree, around, k, True), k, queries, tasks), "near")
    more = _answers(index, _routed(near, tree, around, k, False), k, queries, tasks)
    both = near.select("cid", F.inline("found")).union(more.select("cid", F.inline("found")))
    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id", "own")
    best = both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    best = best.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("best"))
    best = materialize(asked.join(best, "cid"), "best")  # so that rows of one vector that all ask can be split in the join
    rows = rows_of(embeddings).where((F.col("vec_id") % every == 0) & has_direction(F.col("vector")))
    answered = materialize(rows, "asking").join(best, "vector").withColumn("query_id", F.col("vec_id"))
    itself = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["own"] == F.col("cid"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != itself), 1, top)
    out = answered.select("query_id", F.posexplode(others).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
