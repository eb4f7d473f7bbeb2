import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from trendloom.llm import contour_eigen, lookup_clusters, projected_neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, x int, n int, cell int, cid long, part int, best string"


@pytest.fixture
def table(spark):
    """Embeddings from (vec_id, vector), with columns named as those that the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "clash", 1, 2, 3, 4, 5, "clash") for i, v in rows], SCHEMA)

    return make


def vectors(n, dim, seed=0, groups=5, spread=0.3):
    r = np.random.default_rng(seed)
    return (r.standard_normal((groups, dim))[r.integers(0, groups, n)] + spread * r.standard_normal((n, dim))).astype(np.float32)


def odd_rows(dim):
    bad = [None, [], [None] * dim, [float("nan"), *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)], [1.0, None, *[1.0] * (dim - 2)]]
    return [(10_000 + 50 * i, v) for i, v in enumerate(bad)]


# clusters


def brute_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, tuple(math.floor(1024 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in by_hash[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centroids[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), o, d, inertia[o], sum(inertia.values()), names[o]) for i, o, d in out)


@pytest.mark.parametrize("case", ["usual", "few", "ties"])
def test_clusters_equal_brute_force(table, case):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(150, 64))]
    if case == "usual":
        rows += odd_rows(64) + [(3, rows[3][1]), (None, rows[5][1]), (200, [0.1] * 63), (201, [0.1] * 65), (202, [-1000.5] * 64)]
    elif case == "few":
        rows = rows[:5] + [(None, rows[6][1])]
    else:  # equal vectors, so that centroids are equal and some stay empty
        rows = [(i, rows[i % 3][1]) for i in range(40)]
    got = lookup_clusters.cluster(table(rows).repartition(5)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows)


def test_tables_give_exact_distances():
    r = np.random.default_rng(4)
    x, c = r.integers(-(1 << 27), 1 << 27, (300, 64)), r.integers(-(1 << 27), 1 << 27, (7, 64))
    x[:100] //= 1 << 24
    assert (lookup_clusters.distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()


def test_clusters_without_rows_or_beyond_longs(table):
    empty = lookup_clusters.cluster(table(odd_rows(64)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert lookup_clusters.cluster(table([])).count() == 0
    with pytest.raises(ValueError):
        lookup_clusters.integers(np.full((1, 64), 1e30))


# whitening


@pytest.mark.parametrize("kind", ["usual", "low rank", "repeated", "close", "tiny", "single"])
def test_contour_integration_finds_all_leading_pairs(kind):
    r = np.random.default_rng(1)
    n = {"tiny": 3, "single": 1}.get(kind, 64)
    q, _ = np.linalg.qr(r.standard_normal((n, n)))
    values = {"low rank": np.r_[np.arange(1, 8.0), np.zeros(57)], "repeated": np.repeat(np.arange(1, 9.0), 8), "close": 1 + 1e-9 * np.arange(64)}.get(kind, r.uniform(0.1, 9, n))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = contour_eigen.leading(v, 16)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == min(16, n, 7 if kind == "low rank" else 64)
    assert np.abs(e - want[: len(e)]).max() < 1e-13 * want[0]
    assert np.abs(v @ x - x * e).max() < 1e-12 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13
    below = contour_eigen.inertia(v)
    for s in (want[0] + 1, want[-1] - 1, want[len(want) // 2] + 1e-7):
        assert below(s) == (want < s).sum()


def test_no_variance_has_no_components():
    assert len(contour_eigen.leading(np.zeros((4, 4)), 16)[0]) == 0 and len(contour_eigen.leading(np.zeros((0, 0)), 16)[0]) == 0


def brute_whitening(rows, dim, limit=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n) for b in range(dim)] for a in range(dim)])
    e, vec = np.linalg.eigh(v)
    e, vec = e[::-1][:limit], vec[:, ::-1][:, :limit]
    out = []
    for i, x in kept:
        w = np.array([float(c - m) for c, m in zip(x, mean, strict=True)]) @ vec / np.sqrt(e)
        out += [(i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), abs(w[k]), e[k] / np.trace(v)) for k in range(len(e))]
    return out


def test_whitening_equals_brute_force(table):
    base = np.random.default_rng(3).standard_normal((90, 9)) * np.arange(1, 10) ** 1.5
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + odd_rows(9)
    rows += [(3, rows[3][1]), (None, rows[5][1]), *((500 + i, rows[7][1]) for i in range(60))]
    got = whitening.whiten(table(rows).repartition(4)).collect()
    want = brute_whitening(rows, 9)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], int(r[3]), r[4])
    for g, w in zip(sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-10) and g[5] == pytest.approx(w[5], rel=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    same = {}  # one sign a component for all rows
    for r in got:
        same.setdefault(r.component, []).append(r.whitened)
    assert all(min(x) < 0 < max(x) for x in same.values())


def test_whitening_of_little_or_odd_tables(table):
    assert whitening.whiten(table([])).count() == 0 and whitening.whiten(table(odd_rows(5))).count() == 0
    assert whitening.whiten(table([(1, [1, 2, 3]), (2, [1, 2, 3])])).count() == 0  # no variance
    two = whitening.whiten(table([(1, [1, 2, 3]), (2, [2, 2, 3]), (7, [1, 2]), (8, [1, 5])])).collect()  # one component each
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.n) for r in two) == [(1, 1, 1.0, 2), (2, 1, 1.0, 2), (7, 1, 1.0, 2), (8, 1, 1.0, 2)]


def test_products_and_deviations_are_exact_beyond_longs():
    y = np.random.default_rng(2).integers(-(1 << 40), 1 << 40, (50, 4))
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.gram(y) == want).all() and (whitening.gram(y >> 20) == (y >> 20).astype(object).T @ (y >> 20).astype(object)).all()
    model = whitening.Model(1 << 30, [int(s) for s in y.sum(axis=0)], np.zeros((4, 0)), np.zeros(0))
    assert whitening.deviations(y, model) == [sum((model.n * int(c) - s) ** 2 for c, s in zip(x, model.sums, strict=True)) for x in y]


# neighbours


def brute_neighbours(rows, top=5, every=50):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:top])]
    return out


def scored(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_small_tables_are_searched_exactly(table):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(160, 12, groups=8))] + odd_rows(12) + [(20_000, [0.0] * 12), (None, [1.0] * 12), (250, [1.0, 2.0]), (251, [2.0, 1.0])]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # copies, some of which ask
    got, want = scored(projected_neighbours.nearest(table(rows).repartition(3))), brute_neighbours(rows)
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got if x[0] in (300, 250)] == [x[2] for x in sorted(want) if x[0] in (300, 250)]
    found = {(q, j) for q, _, j, _ in got}
    assert sum((q, j) in found for q, _, j, _ in want) >= 0.9 * len(want)
    exact = {(q, j): s for q, _, j, s in brute_neighbours(rows, top=1000)}
    assert all(s == pytest.approx(exact[q, j], abs=1e-15) for q, _, j, s in got)


def test_rows_that_repeat_an_id_and_few_candidates(table):
    rows = [(50, [1, 0, 0]), (50, [1, 0, 0]), (50, [0, 1, 0]), (1, [1, 1, 0])]
    got = scored(projected_neighbours.nearest(table(rows)))
    assert len(got) == 9 and sorted((q, r, j, round(s, 6)) for q, r, j, s in got) == sorted((q, r, j, round(s, 6)) for q, r, j, s in brute_neighbours(rows))
    assert projected_neighbours.nearest(table([])).count() == 0
    assert projected_neighbours.nearest(table([(50, [1, 2])])).count() == 0
    assert projected_neighbours.nearest(table([(1, [1, 2]), (2, [1, 3])])).count() == 0


@pytest.mark.parametrize(("spread", "sizes"), [
    (0.3, {}), (3.0, {}), (0.5, {"cell_size": 100, "sample": 1 << 10, "queries": 7}),
    (0.5, {"cell_size": 40, "sample": 128}), (0.5, {"cell_size": 40, "sample": 128, "most_cells": 6})])
def test_recall_over_cells_and_parts(table, spread, sizes):
    """Clustered and unstructured vectors, in one cell and in many small ones, below trees of their own or cut into parts."""
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 32, groups=40, spread=spread))]
    got, want = scored(projected_neighbours.nearest(table(rows), **sizes)), brute_neighbours(rows)
    assert len(got) == len(want)
    found = {(q, j) for q, _, j, _ in got}
    assert sum((q, j) in found for q, _, j, _ in want) >= 0.95 * len(want)


def test_a_dense_region_gets_cells_of_its_own(table):
    rng = np.random.default_rng(6)
    close = rng.standard_normal(24) + 0.02 * rng.standard_normal((1200, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((close, rng.standard_normal((400, 24)))))]
    found = projected_neighbours.classes(table(rows), 6, 50).cache()
    tree = projected_neighbours.fitted(projected_neighbours.sampled(found, 1600, 128), 2)
    index = projected_neighbours.indexed(found, tree)
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    levels = projected_neighbours.lower_levels(sizes, 100, 512, 64)
    grown = tree.grown(projected_neighbours.lower_trees(index, sizes, levels))
    around = projected_neighbours.boxes(projected_neighbours.indexed(found, grown), 100)
    assert max(sizes.values()) > 300 and len(around.cell) > 8 and around.parts.max() <= 3
    got, want = scored(projected_neighbours.nearest(table(rows), cell_size=100, sample=128)), brute_neighbours(rows)
    assert len(got) == len(want)
    known = {(q, j) for q, _, j, _ in got}
    assert sum((q, j) in known for q, _, j, _ in want) >= 0.95 * len(want)


def test_levels_below_leaves_are_bounded():
    sizes = {3: 4096, 4: 4097, 5: 1 << 20, 6: 1 << 30}
    assert projected_neighbours.lower_levels(sizes, 4096, 1 << 16, 1 << 16) == {4: 1, 5: 8, 6: 11}
    assert projected_neighbours.lower_levels(sizes, 4096, 1 << 16, 300) == {4: 1, 5: 7, 6: 7}
    assert projected_neighbours.lower_levels(sizes, 4096, 1 << 16, 1) == {} and projected_neighbours.lower_levels({}, 4096, 1 << 16, 9) == {}


def test_trees_in_the_places_of_leaves():
    points = np.random.default_rng(5).standard_normal((500, projected_neighbours.PROJECTIONS))
    upper = projected_neighbours.fitted(points, 2)
    own = upper.cells(points)
    assert sorted(set(own.tolist())) == [3, 4, 5, 6] and np.bincount(own)[3:].min() >= 120
    below = {leaf: projected_neighbours.fitted(points[own == leaf], levels) for leaf, levels in ((3, 3), (5, 1))}
    grown = upper.grown(below)
    cells = grown.cells(points)
    assert (grown.below[np.unique(cells)] == -1).all() and len(np.unique(cells)) == 8 + 2 + 2
    assert (cells[own == 4] == 4).all() and (cells[own == 6] == 6).all()
    for leaf, tree in below.items():
        inside = tree.cells(points[own == leaf])
        assert len({(a, b) for a, b in zip(inside.tolist(), cells[own == leaf].tolist(), strict=True)}) == len(np.unique(inside))


def test_quantile_and_projected_distances():
    assert projected_neighbours.quantile(0.95, 12) == pytest.approx(21.026069817483066, abs=1e-9)
    a = np.random.default_rng(0).standard_normal((4000, 16))
    off = (a @ projected_neighbours.directions(16)) ** 2
    share = (off.sum(axis=1) / (a * a).sum(axis=1) <= projected_neighbours.REACH).mean()
    assert 0.93 < share < 0.97
