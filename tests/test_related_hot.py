"""Related concepts with tokens that all or many names hold."""

import random

import pytest

from trendloom.operators import graph


@pytest.mark.parametrize("hot", [1, 5, 20, 1000])
def test_against_all_pairs(spark, hot):
    r = random.Random(5)
    names = sorted({" ".join(r.sample(["model"] * (r.random() < 0.9) + ["graph"] * (r.random() < 0.5) + ["deep"] * (r.random() < 0.3) + [f"tok{r.randint(0, 25)}", f"own{r.randint(0, 999)}"], k=2)) + r.choice(("", " model")) for _ in range(70)} | {"lone model", "none shared"})
    tokens = {n: {t for t in n.split() if len(t) > 3} for n in names}
    want = set()
    for a in names:
        found = sorted((-len(tokens[a] & tokens[b]), b) for b in names if b != a and tokens[a] & tokens[b])
        want |= {(a, b, -s) for s, b in found[:8]}
    got = graph.related_concepts(spark.createDataFrame([(n,) for n in names], "concept_name string"), hot=hot)
    assert {tuple(x) for x in got.collect()} == want
    assert sum(a == "lone model" for a, _, _ in want) == 8
