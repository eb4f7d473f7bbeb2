"""The registered query with the default pivots equals brute-force Brandes over the documents' concepts."""

import random
from collections import deque

import pytest

from trendloom.plans import registry


def brandes(pairs):
    nodes = sorted({x for p in pairs for x in p})
    ahead = {x: sorted(b for a, b in pairs if a == x) for x in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b in ahead[a]:
                if b not in dist:
                    dist[b], sigma[b] = dist[a] + 1, 0.0
                    queue.append(b)
                if dist[b] == dist[a] + 1:
                    sigma[b] += sigma[a]
        dep = dict.fromkeys(nodes, 0.0)
        for a in reversed(order):
            dep[a] = sum(sigma[a] / sigma[b] * (1 + dep[b]) for b in ahead[a] if dist[b] == dist[a] + 1)
            if a != s:
                total[a] += dep[a]
    n = len(nodes)
    return {x: t / ((n - 1) * (n - 2)) for x, t in total.items()}


def test_default_pivots_reach_every_concept(spark, tmp_path):
    r = random.Random(3)
    names = ["".join(r.choice("bcdfgklm") + r.choice("aeiou") for _ in range(3)) for _ in range(40)]
    papers = [names[k : k + 4] for k in range(0, 37, 3)] + [r.sample(names, 3) for _ in range(4)]  # a long chain with a few short cuts
    rows = [(k, " ".join(p), "en", "s", 0) for k, p in enumerate(papers)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(a, b) for p in papers for a in p for b in p if a != b}
    want = brandes(pairs)
    got = {x.concept_name: x for x in registry.QUERIES["betweenness_default"](spark, str(tmp_path)).collect()}
    assert {k: x.centrality_score for k, x in got.items()} == pytest.approx(want, abs=2e-9)
    assert {(x.graph_node_count, x.graph_edge_count) for x in got.values()} == {(len(want), len(pairs))}
    six = {x.concept_name: x.centrality_score for x in registry.QUERIES["betweenness"](spark, str(tmp_path)).collect()}
    assert six != pytest.approx(want, abs=1e-3)  # six pivots don't do
