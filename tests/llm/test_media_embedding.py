import hashlib
import math
import tarfile
import zlib

import numpy as np
import pytest

from trendloom.llm import embedding_lsh, media, vectors


def test_png_round_trip():
    for text in (None, "", "é", "x" * 64, "y" * 65, "z" * 100_000):
        payload, n = media.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == (text or "").encode() and not payload[n:].strip(b"\0")
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        assert media.read_header(stored[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8, 0)
    with pytest.raises(ValueError):
        media.read_header(b"\0" * 33)


def test_media_columns(docs):
    rows = [(1, "one"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "é" * 5000)]
    got = media.media_columns(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        payload, n = media.payload_of(dict(rows)[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest() and r.media_bytes == len(media.to_png(payload))
        assert r.feature.startswith(f"png:64x{len(payload) // 64}:8bit:colour0:")
    same = {(r.media_sha256, r.feature, r.tail_crc32) for r in got if r.doc_id in (1, 4)}
    assert len(same) == 1
    assert media.media_columns(docs([])).count() == 0


def test_shards_are_tar_files_and_roll(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = media.store(docs([(k, f"text {k % 6} " * 50) for k in range(40)]).coalesce(1), folder, shard_bytes=2000)
    rows = index.collect()
    assert len({r.shard for r in rows}) > 1
    for r in rows:
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            entry = tar.getmember(f"{r.digest}.png")
            assert (entry.offset_data, entry.size) == (r.offset, r.length)
            assert len(tar.getnames()) == len(set(tar.getnames()))


def test_payloads_are_read_from_rows_alone(docs, tmp_path):
    """Also after other calls wrote to the same store, and from tasks that share the bytes evenly."""
    rows = {k: f"text {k % 9} ü" * (20 + 50 * (k % 5)) for k in range(60)} | {99: None}
    first = media.media_columns(docs(list(rows.items())), f"file://{tmp_path}/store").collect()
    again = media.media_columns(docs([(1, "later")]), f"file://{tmp_path}/store").collect()
    for r in first:
        assert media.read_payload(r.shard, r.offset, r.media_bytes, r.n_bytes).decode() == (rows[r.doc_id] or "")
    assert media.read_payload(again[0].shard, again[0].offset, again[0].media_bytes, again[0].n_bytes) == b"later"


def test_reading_back_is_dealt_by_bytes(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RUN_BYTES", 4096)
    monkeypatch.setattr(media, "TASK_BYTES", 8192)
    index = media.store(docs([(k, np.random.default_rng(k).bytes(900).hex()) for k in range(100)]).coalesce(1), f"file://{tmp_path}/s")
    sizes = media.by_bytes(index).rdd.mapPartitions(lambda rows: [sum(r.length for r in rows)]).collect()
    assert len(sizes) >= 10 and max(sizes) < 4 * sum(sizes) / len(sizes)


def brute(vectors, cosine=0.9):
    ids = sorted({v for v, _ in vectors})
    ok = {v: np.array(x, float) for v, x in vectors if x and all(y is not None and np.isfinite(y) for y in x) and any(x)}
    links = {v: 0 for v in ids}
    root = {v: v for v in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: (links[v], find(v), find(v) == v) for v in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    for name in ("BLOCK", "FILL", "ROWS"):
        monkeypatch.setattr(embedding_lsh, name, block)
    draw = np.random.default_rng(7)
    base = draw.normal(size=(25, 32))
    rows = [(k, (base[k % 25] + draw.normal(size=32) * 0.12 * (k >= 25)).astype(np.float32).tolist()) for k in range(160)]
    rows += [(k, rows[3][1]) for k in range(200, 230)] + [(300, (np.array(rows[3][1]) * 1e30).astype(np.float32).tolist())]
    rows += [(400, None), (401, [0.0] * 32), (402, [float("nan")] + [1.0] * 31), (403, [float("inf")] + [1.0] * 31), (404, [None] + [1.0] * 31), (405, []), (406, [1.0]), (407, [2.0]), (408, [-1.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, cid int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_lsh.near_duplicates(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    missed = sum(want[v][0] - got[v][0] for v in want)
    assert all(got[v][0] <= want[v][0] for v in want) and missed <= 0.01 * sum(x[0] for x in want.values())
    assert all(got[v] == want[v] for v in want if v >= 400) and got[300][0] == want[300][0]


def test_plan_follows_the_number_of_vectors():
    small, large = embedding_lsh.plan(1000), embedding_lsh.plan(10**9)
    assert small.projections == 10 and small.tables == 25 and large.projections > 20
    for n in (10**3, 10**6, 10**9):
        form = embedding_lsh.plan(n)
        assert 1 - (1 - embedding_lsh.meets(0.9) ** form.projections) ** form.tables >= embedding_lsh.RECALL
        assert n * embedding_lsh.meets(0.0) ** form.projections <= embedding_lsh.FILL
    draw = np.random.default_rng(1)
    x = vectors.unit(draw.normal(size=(4000, 64)))
    y = vectors.unit(0.9 * x + np.sqrt(1 - 0.81) * vectors.unit(draw.normal(size=(4000, 64))))
    at = (x * y).sum(axis=1)
    form = embedding_lsh.Form(30, 1)
    same = (embedding_lsh.bucket_keys(x, form) == embedding_lsh.bucket_keys(y, form)).mean()
    assert same == pytest.approx(np.mean([embedding_lsh.meets(c) for c in at]), abs=0.01)


@pytest.mark.parametrize("form", [None, (63, 15)])
def test_recall_of_pairs_at_the_threshold(spark, form):
    """Pairs with cosines from 0.9 to 0.93 among unrelated vectors: at least 0.95 of them are linked, nothing else is."""
    draw = np.random.default_rng(3)
    unit = lambda n: (x := draw.normal(size=(n, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    a, noise = unit(600), unit(600)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    cosine = draw.uniform(0.9001, 0.93, (600, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b, unit(1500)]))]
    found = embedding_lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), form=form and embedding_lsh.Form(*form)).collect()
    linked = sum(r.vec_id >= 600 and r.component_id == r.vec_id - 600 for r in found)
    print(f"recall {linked / 600:.3f}")
    assert linked >= 0.95 * 600 and sum(r.n_links for r in found) == 2 * linked


@pytest.mark.parametrize("spread", [0.02, 0.05])
def test_crowds_are_counted_and_not_copied(spark, monkeypatch, spread):
    """A crowd of close vectors, in part a ball, beside another one near by, and vectors between: all links, and few rows in cells."""
    monkeypatch.setattr(embedding_lsh, "BLOCK", 64)
    monkeypatch.setattr(embedding_lsh, "FILL", 64)
    draw = np.random.default_rng(11)
    base = draw.normal(size=32)
    base /= np.linalg.norm(base)
    other = draw.normal(size=32)
    other -= (other @ base) * base
    other = 0.93 * base + math.sqrt(1 - 0.93**2) * other / np.linalg.norm(other)
    near = lambda centre, n: centre + spread * draw.normal(size=(n, 32))
    rows = np.concatenate([near(base, 900), near(other, 300), near((base + other) / 2, 20), draw.normal(size=(300, 32))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    counted, cells = [], embedding_lsh._cells
    monkeypatch.setattr(embedding_lsh, "_cells", lambda *a: counted.append(cells(*a)) or counted[0])
    got = {r.vec_id: r for r in embedding_lsh.near_duplicates(df, form=embedding_lsh.Form(25, 10)).collect()}
    found = np.array([got[k].n_links for k in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert {got[k].component_id for k in range(1220)} == {0}
    if spread == 0.02:  # two balls: in every table the larger meets blocks of the smaller at most
        pairs_of_blocks = 25 * 900 * (900 / 64)
        assert counted[0].count() < 0.5 * pairs_of_blocks


def test_embeddings_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0) for r in embedding_lsh.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (5, 1, 5), (6, 1, 5)]
    assert embedding_lsh.near_duplicates(df.limit(0)).count() == 0
