from itertools import combinations, product

import numpy as np
import pytest

from trendloom.llm import simhash
from trendloom.llm.common import components


def brute(rows):
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_golay_code_is_perfect():
    leader, weight, beyond = simhash.golay_tables()
    assert [int((weight == k).sum()) for k in range(4)] == [1, 23, 253, 1771]
    assert all(len(set(b)) == 5 for b, w in zip(beyond.tolist(), weight.tolist(), strict=True) if w == 3)
    assert (simhash.syndromes(leader) == np.arange(2048)).all()


@pytest.mark.parametrize("form", [simhash.NARROW, simhash.WIDE])
def test_probes_hold_the_index_of_every_word_one_bit_away(form):
    draw, tables = np.random.default_rng(3), simhash.golay_tables()
    fps = draw.integers(0, 1 << 64, 100, dtype=np.uint64)
    for shift, bits in form.segments:
        word = lambda x: (x >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)  # noqa: B023, E731
        probes = simhash.segment_indices(word(fps), tables)
        for bit in range(bits):
            near = simhash.segment_indices(word(fps ^ np.uint64(1 << (shift + bit))), tables)[:, 0]
            assert (probes == near[:, None]).any(axis=1).all()


def test_layout_follows_the_number_of_fingerprints():
    assert simhash.layout(1000) is simhash.NARROW and simhash.layout(simhash.NARROW_MAX + 1) is simhash.WIDE
    for form in (simhash.NARROW, simhash.WIDE):  # every way to put three errors into the segments is held by some key
        n = len(form.segments)
        for errors in product(range(4), repeat=n):
            if sum(errors) <= 3:
                assert any(all(errors[k] == 0 for k in equal) and all(errors[k] <= 1 for k in pair) for equal, pair in form.keys)


@pytest.mark.parametrize("form", [simhash.NARROW, simhash.WIDE])
def test_every_pair_within_three_bits_is_found_once(spark, form):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 64, 60, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for n in (1, 2, 3, 4, 5):
            for b in draw.choice(64, n, replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), form).collect()]
    want = {tuple(sorted(p)) for p in combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark, docs, prose):
    text = prose("en", 400)
    words = text.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (5, 100, 300)]
    rows = [(5, text), (3, text), (9, None), (8, ""), (7, " \t\n"), (1, "Two WORDS"), (2, "two words"), (4, "x"), *enumerate(near, 20), *((k, prose("de", 50)) for k in range(30, 60))]
    rows.append((70, "A b É " * 3000))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)
    assert got[9] == ("0" * 16, 7) and got[1][1] == got[2][1] == 1 and got[5][1] == 3


def test_non_ascii_case_stays():
    assert simhash.fingerprint("É a b") != simhash.fingerprint("é a b")
    assert simhash.fingerprint("A b C") == simhash.fingerprint("a\vB\fc")


def test_rows_that_repeat_and_no_rows(spark, docs):
    df = docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q")])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.drop_near_duplicates(docs([(2, "a b c"), (1, "a b c"), (1, "a b c"), (None, "a b c"), (4, "zz yy xx ww")]))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_unlike_texts_of_one_id_stay_and_null_ids_take_part(docs, prose):
    a, b, c = (prose("en", 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, b), (None, a), (None, prose("de", 40)), (None, None), (4, "")]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(docs(rows)).collect())
    assert got == sorted([(1, a), (1, b), (2, c), (0, rows[6][1]), (4, "")])


@pytest.mark.parametrize("n", [0, 1])
def test_drop_of_small_tables(docs, n):
    assert simhash.drop_near_duplicates(docs([(1, None)][:n])).count() == n
