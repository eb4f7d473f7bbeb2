"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; the projections of a table, shifted and quantised to
steps of STEP, name the vector's bucket there. Pairs that share a bucket are checked by their cosine in double
precision. `plan` takes as many projections as keep unrelated vectors from filling buckets (10 up to some hundred
thousand vectors, one more for each doubling), and as many tables as find a pair at the threshold with
probability RECALL; closer pairs are found more often. So buckets stay of one size and the tables grow with the
0.27th power of the number of vectors.

Equal vectors are one class first. Pairs are never written out: a bucket is cut into blocks of about
BLOCK vectors, each pair of blocks is compared by matrix products, and what leaves it is one row
per vector with its number of links and the smallest vector it hangs together with. A pair counts in the first
table where its buckets are equal, so once.

Crowds of close vectors need no comparison with each other. The vectors of a crowded bucket are added up, and so are the sums of
buckets that lie near each other (by a coarse hash of their own). Vectors within half the
threshold's angle of such a sum lie within the whole angle of each other, by the triangle inequality, so all of them link: they
are a ball, whose links are counted by its size. A vector is in one ball at most. In buckets, blocks of a ball meet blocks of what
isn't in it, never each other, so a crowd isn't copied for its own blocks, in no table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import components, materialize, spread
from trendloom.llm.vectors import has_direction, matrices, rows_of, unit

STEP = 2.2
#: Vectors at right angles that share a bucket, at most.
FILL = 1024
#: Vectors of a block, about, and those compared with a block at once.
BLOCK, ROWS = 4096, 512
#: What the half angle's cosine is raised by, so that rounding makes no link below the threshold.
MARGIN = 1e-9
COSINE = 0.9
RECALL = 0.99
LEAST_PROJECTIONS = 10
SEED = 29


class Form(NamedTuple):
    """How many tables, and how many projections name a table's bucket."""

    tables: int
    projections: int


def meets(cosine: float) -> float:
    """Probability that one quantised projection of two unit vectors with this cosine is the same (Datar et al. 2004)."""
    if cosine >= 1:
        return 1.0
    ratio = STEP / math.sqrt(2 - 2 * cosine)
    return math.erf(ratio / math.sqrt(2)) - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def plan(n: int, cosine: float = COSINE) -> Form:
    """Projections so that about FILL of n vectors at right angles share a bucket at most, and tables for RECALL at the threshold."""
    projections = max(LEAST_PROJECTIONS, math.ceil(math.log(max(n, 1) / FILL) / -math.log(meets(0.0))))
    return Form(max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-min(meets(cosine) ** projections, 0.999)))), projections)


@functools.lru_cache(4)
def directions(dim: int, form: Form, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([seed, dim])
    return draw.standard_normal((dim, form.tables * form.projections)), draw.uniform(0, STEP, form.tables * form.projections)


def bucket_keys(unit: np.ndarray, form: Form, seed: int = SEED) -> np.ndarray:
    """(n, tables) bucket names of unit vectors."""
    across, shift = directions(unit.shape[1], form, seed)
    steps = np.floor((unit @ across + shift) / STEP).astype(np.int64).reshape(len(unit), form.tables, form.projections)
    mixed = np.full(steps.shape[:2], unit.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(form.projections):
            mixed = (mixed ^ steps[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def classes(embeddings: DataFrame) -> DataFrame:
    """`cid, copies, vector`: one row per distinct usable vector; cid is its smallest vec_id."""
    rows = rows_of(embeddings).where(has_direction(F.col("vector")) & F.col("vec_id").isNotNull())
    return rows.groupBy("vector").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).select("cid", "copies", "vector")


def _keyed(found: DataFrame, form: Form) -> DataFrame:
    """`t, key, cid`: the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(0).to_numpy()
            for rows, vectors in matrices(batch.column(1)):
                for at in range(0, len(rows), FILL):
                    keys = bucket_keys(unit(vectors[at : at + FILL]), form)
                    own = cid[rows[at : at + FILL]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(form.tables, dtype=np.int32), len(own))), pa.array(keys.ravel()), pa.array(np.repeat(own, form.tables))], ["t", "key", "cid"])

    return spread(found.select("cid", "vector")).mapInArrow(run, "t int, key long, cid long")


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' component, by repeated minima over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def balls(found: DataFrame, keyed: DataFrame, crowded: DataFrame, cosine: float) -> DataFrame:
    """`cid, ball, others`: vectors that link with all of a ball (named by its smallest cid), and how many other rows that has.

    A vector is looked at in the first of its `crowded(t, key)` buckets; its vector moves once for that. Sums are pre-aggregated.
    """
    half = math.sqrt((1 + cosine) / 2) + MARGIN
    first = keyed.join(crowded.select("t", "key"), ["t", "key"]).groupBy("cid").agg(F.min(F.struct("t", "key")).alias("place"))
    rows = materialize(found.join(first, "cid").select("place.t", "place.key", "cid", "copies", "vector"), "crowds")
    each = rows.select("t", "key", F.posexplode("vector").alias("at", "x")).groupBy("t", "key", "at").agg(F.sum(F.col("x").cast("double")).alias("x"))


    def added(parts: DataFrame, *key: str) -> DataFrame:
        return parts.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, centres in matrices(batch.column(2)):
                with np.errstate(all="ignore"):
                    named = np.nan_to_num(unit(centres))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in range(3)), pa.array(bucket_keys(named, Form(1, 4), SEED + 1)[:, 0])], ["t", "key", "centre", "crowd"])

    sums = materialize(added(each, "t", "key").mapInArrow(coarse, "t int, key long, centre array<double>, crowd long"), "centres")
    whole = sums.select("crowd", F.posexplode("centre").alias("at", "x")).groupBy("crowd", "at").agg(F.sum("x").alias("x"))
    sums = materialize(sums.join(added(whole, "crowd").withColumnRenamed("centre", "middle"), "crowd"), "middles")

    def near(vectors: list[tuple[np.ndarray, np.ndarray]], centres: pa.Array, n: int) -> np.ndarray:
        inside, of = np.zeros(n, bool), {m.shape[1]: (r, m) for r, m in matrices(centres)}
        for own, points in vectors:
            at, centre = of.get(points.shape[1], (own[:0], points[:0]))
            both, i, j = np.intersect1d(own, at, assume_unique=True, return_indices=True)
            with np.errstate(all="ignore"):  # a sum may overflow or vanish; then nothing is near it
                inside[both] = (unit(points[i]) * unit(centre[j])).sum(axis=1) >= half
        return inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrices(batch.column(4))
            middle, own = (near(vectors, batch.column(c), batch.num_rows) for c in (6, 5))
            t = np.where(middle, -1, batch.column(0).to_numpy()).astype(np.int32)
            key = np.where(middle, batch.column(7).to_numpy(), batch.column(1).to_numpy())
            kept = pa.array(middle | own)
            yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (pa.array(t), pa.array(key), batch.column(2), batch.column(3))], ["t", "key", "cid", "copies"])

    members = rows.join(sums, ["t", "key"]).select("t", "key", "cid", "copies", "vector", "centre", "middle", "crowd").mapInArrow(run, "t int, key long, cid long, copies long")
    members = materialize(members, "members")
    named = members.groupBy("t", "key").agg(F.min("cid").alias("ball"), F.sum("copies").alias("size"), F.count("*").alias("n")).where("n > 1")
    return materialize(members.join(named, ["t", "key"]).select("cid", "ball", (F.col("size") - F.col("copies")).alias("others")), "balls")


def _cells(keyed: DataFrame, sizes: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """`CELL, side, ball, cid`: which vectors are compared where; `most` is the size of the largest bucket.

    A bucket of up to BLOCK vectors is one block. A larger one has blocks of each ball with half a block of it, and blocks of all else;
    pairs of blocks are cells, but those within a ball.
    """
    ball = F.coalesce("ball", F.lit(-1)).alias("ball")
    rows = keyed.join(sizes, ["t", "key"]).join(near.select("cid", "ball"), "cid", "left").select("t", "key", "cid", "n", ball)
    small = rows.where(F.col("n") <= BLOCK).select("t", "key", *[F.lit(-1).cast("long").alias(c) if c.endswith("group") else F.lit(0).alias(c) for c in CELL[2:]], F.lit(0).alias("side"), "ball", "cid")
    if most <= BLOCK:
        return small.select(*CELL, "side", "ball", "cid")
    large = rows.where(F.col("n") > BLOCK)
    held = large.where("ball >= 0").groupBy("t", "key", F.col("ball").alias("group")).agg(F.count("*").alias("m")).where(F.col("m") >= BLOCK // 2)
    large = large.join(held.select("t", "key", F.col("group").alias("ball"), F.col("group")), ["t", "key", "ball"], "left").withColumn("group", F.coalesce("group", F.lit(-1).cast("long")))
    blocks = large.groupBy("t", "key", "group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "blocks")
    lists = blocks.groupBy("t", "key").agg(F.collect_list(F.struct("group", "blocks")).alias("list"))  # of a bucket: two entries a block at most
    placed = large.join(blocks, ["t", "key", "group"]).withColumn("own", F.struct("group", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")))
    partners = F.flatten(F.transform(F.filter("list", lambda e: (e["group"] != F.col("group")) | (F.col("group") < 0)), lambda e: F.transform(
        F.sequence(F.lit(0), e["blocks"] - 1), lambda b: F.struct(e["group"].alias("group"), b.alias("block")))))
    met = placed.join(lists, ["t", "key"]).select("t", "key", "ball", "cid", "own", F.explode(partners).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("t", "key", low["group"].alias("low_group"), low["block"].alias("low"), high["group"].alias("high_group"), high["block"].alias("high"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "ball", "cid")
    return small.select(*CELL, "side", "ball", "cid").union(met.select(*CELL, "side", "ball", "cid"))


def compare(t: int, side: np.ndarray, inner: bool, ball: np.ndarray, vectors: np.ndarray, form: Form, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell, found first in table t and not within a ball: row numbers of both ends."""
    points = unit(vectors)
    a = np.arange(len(points)) if inner else np.flatnonzero(side == 0)
    b = a if inner else np.flatnonzero(side == 1)
    keys = bucket_keys(points, form)[:, :t] if len(a) and len(b) else np.zeros((0, 0), np.int64)
    left, right = [a[:0]], [a[:0]]
    for at in range(0, len(a) if len(b) else 0, ROWS):
        i, j = np.nonzero(points[a[at : at + ROWS]] @ points[b].T >= cosine)
        i, j = a[i + at], b[j]
        on = (i < j) if inner else np.ones(len(i), bool)
        on &= (ball[i] < 0) | (ball[i] != ball[j])
        i, j = i[on], j[on]
        on = np.ones(len(i), bool)
        for before in range(t):
            on &= keys[i, before] != keys[j, before]
        left.append(i[on])
        right.append(j[on])
    return np.concatenate(left), np.concatenate(right)


#: What names a cell: the bucket, and the two blocks (each the block of a ball, or of what is in none: -1).
CELL = ["t", "key", "low_group", "low", "high_group", "high"]


def _linked(cells: DataFrame, form: Form, cosine: float) -> DataFrame:
    """`cid, root, links` per cell and class with a link; cells stand together and in order."""
    def solve(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        [(_, vectors)] = matrices(cell.column(10))
        t, _, low_group, low, high_group, high = (cell.column(k)[0].as_py() for k in range(6))
        side, ball, cid, copies = (cell.column(k).to_numpy() for k in range(6, 10))
        left, right = compare(t, side, (low_group, low) == (high_group, high), ball, vectors, form, cosine)
        if not len(left):
            return None
        links = np.bincount(left, copies[right], len(cid)) + np.bincount(right, copies[left], len(cid))
        order = np.argsort(cid, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(cid))
        root = cid[order][_roots(len(cid), place[left], place[right])][place]
        on = links > 0
        return pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(root[on]), pa.array(links[on].astype(np.int64))], ["cid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and sum(x.num_rows for x in held) > 1:
                cell = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                if (out := solve(cell)) is not None:
                    yield out
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(k).to_numpy() for k in range(6)]
            edge = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                if held and any(held[-1].column(k)[-1].as_py() != marks[k][a] for k in range(6)):
                    yield from flush()
                held.append(batch.slice(a, b - a))
        yield from flush()

    return cells.select(*CELL, "side", "ball", "cid", "copies", "vector").mapInArrow(run, "cid long, root long, links long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, form: Form | None = None) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row of `embeddings(vec_id, embedding)`.

    n_links counts the other rows linked to this one: cosine at least `cosine` (equal vectors link), found
    in some table. component_id is the smallest vec_id reachable over links, itself included. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Rows that repeat a vec_id and its vector are rows of their own; a null
    vec_id links with nothing. An empty table gives no rows. `form` is by default that of `plan` for the distinct vectors.
    """
    found = materialize(classes(embeddings), "classes")
    form = form or plan(found.count(), cosine)
    keyed = materialize(_keyed(found, form), "keys")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    most = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    none = embeddings.sparkSession.createDataFrame([], "cid long, ball long, others long")
    near = balls(found, keyed, sizes.where(F.col("n") > FILL), cosine) if most > FILL else none
    cells = _cells(keyed, sizes, near, most).join(found, "cid").repartition(*CELL).sortWithinPartitions(*CELL, "cid")
    linked = materialize(_linked(cells, form, cosine).union(near.select("cid", F.col("ball").alias("root"), F.col("others").alias("links"))), "linked")
    roots = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    known = found.join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select(
        F.col("vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    rows = rows_of(embeddings).withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector")))
    out = rows.join(known, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
