"""Graph, centrality and signals on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.operators import centrality, graph, signals


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def scores(df):
    return {r.concept_name: r.centrality_score for r in df.collect()}


def test_chain_and_triangle(spark):
    assert scores(centrality.betweenness(edges(spark, [("a", "b"), ("b", "c")]))) == {"a": 0.0, "b": 0.5, "c": 0.0}
    got = centrality.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])).collect()
    assert [r.centrality_score for r in got] == [0, 0, 0] and got[0].graph_node_count == 3 and got[0].graph_edge_count == 3


def test_empty_graph_and_top_n(spark):
    assert centrality.betweenness(edges(spark, [])).count() == 0
    hub = [("hub", f"l{k}") for k in range(6)] + [(f"l{k}", "hub") for k in range(6)]
    got = centrality.betweenness(edges(spark, hub), top_n=3).collect()
    assert len(got) == 3 and got[0].concept_name == "hub" and got[0].centrality_score == pytest.approx(1.0)


def test_all_pivots_equal_plain_brandes(spark):
    import random

    r = random.Random(4)
    pairs = sorted({(f"n{r.randint(0, 11)}", f"n{r.randint(0, 11)}") for _ in range(40)})
    pairs = [(a, b) for a, b in pairs if a != b]
    nodes = sorted({x for p in pairs for x in p})
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, at = {s: 0}, {s: 1.0}, [s], 0
        while at < len(order):
            v = order[at]
            at += 1
            for a, b in pairs:
                if a == v:
                    if b not in dist:
                        dist[b], sigma[b] = dist[v] + 1, 0.0
                        order.append(b)
                    if dist[b] == dist[v] + 1:
                        sigma[b] += sigma[v]
        dep = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for a, b in pairs:
                if b == w and a in dist and dist[w] == dist[a] + 1:
                    dep[a] += sigma[a] / sigma[w] * (1 + dep[w])
            if w != s:
                want[w] += dep[w]
    n = len(nodes)
    got = scores(centrality.betweenness(edges(spark, pairs), k_samples=n, top_n=None))
    assert got == pytest.approx({k: x / ((n - 1) * (n - 2)) for k, x in want.items()} | {}, abs=1e-12)


def test_sanitize(spark):
    rows = [("it's a test",), ("back\\slash",), ("cost $100",), ("line1\nline2",), ("x" * 300,), (None,), ("\t a\tb \u00a0",), (" " * 250 + "x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(graph.sanitize(F.col("t"))).collect()]
    assert got == ["its a test", "backslash", "cost 100", "line1 line2", "x" * 200, "", "a\tb", ""]


def test_graph_of_two_papers(spark):
    papers = spark.createDataFrame([("p1", "T1", dt.datetime(2023, 5, 1)), ("p2", "T2", None)], "arxiv_id string, title string, published_at timestamp")
    ex = spark.createDataFrame([("p1", ["A", "B", "A", ""], ["M"]), ("p2", ["A"], ["B"])], "arxiv_id string, concepts array<string>, methods array<string>")
    authors = spark.createDataFrame([("p1", "a1", "Ann")], "paper_id string, author_id string, author_name string")
    cites = spark.createDataFrame([("p1", "s9", "citation"), ("p1", "s8", "reference"), ("p2", "p1", "citation")], "source_arxiv_id string, cited_paper_id string, citation_type string")
    v = {(r.label, r.key, r.year) for r in graph.vertices(papers, ex, authors, cites).collect()}
    assert v == {("Paper", "p1", 2023), ("Paper", "p2", None), ("Paper", "s9", None), ("Author", "a1", None), ("Concept", "A", None), ("Concept", "B", None), ("Concept", "M", None)}
    e = {(r.src, r.rel, r.dst) for r in graph.edges(ex, authors, cites).collect()}
    assert e == {("p1", "BY", "a1"), ("p1", "MENTIONS", "A"), ("p1", "MENTIONS", "B"), ("p2", "MENTIONS", "A"), ("p1", "USES_METHOD", "M"), ("p2", "USES_METHOD", "B"), ("p1", "CITES", "s9"), ("p2", "CITES", "p1")}
    co = {(r.src, r.dst) for r in graph.cooccurrence(graph.mentions(ex)).collect()}
    assert co == {("A", "B"), ("B", "A")}
    m = {r.arxiv_id: (r.concepts_issued, r.edges_issued) for r in graph.build_metrics(ex, authors, cites).collect()}
    assert m == {"p1": (4, 6), "p2": (2, 3)}


BRIDGE = "concept_name string, centrality_score double"
VELOCITY = "concept_name string, velocity double, acceleration double, trend string"


def test_minmax(spark):
    for values, want in (([], []), ([5.0], [0.0]), ([3.0, 3.0, 3.0], [0.0] * 3), ([10.0, 20.0, 30.0], [0.0, 0.5, 1.0])):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        assert sorted(r.norm_x for r in signals.minmax(df, "x").collect()) == want


def test_rank_and_pages(spark):
    b = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.5)], BRIDGE)
    v = spark.createDataFrame([("a", 0.0, 0.0, "stable"), ("b", 10.0, 1.0, "accelerating")], VELOCITY)
    got = {r.concept_name: (round(r.composite_score, 6), r.trend) for r in signals.rank(b, v).collect()}
    assert got == {"a": (0.6, "stable"), "b": (0.4, "accelerating"), "c": (0.3, "stable")}
    whole = [r.concept_name for r in signals.rank(b, v).collect()]
    pages = [r.concept_name for k in range(0, 4, 2) for r in signals.page(b, v, 2, k).collect()]
    assert pages == whole and signals.page(b, v, 2, 9).count() == 0
    only = signals.query_graph(b, v, 20, "accelerating").collect()
    assert [(r.concept_name, r.composite_score) for r in only] == [("b", 0.0)]


def test_case_dedup_and_counts(spark):
    df = spark.createDataFrame([("deep learning", 0.2, "stable"), ("Deep Learning", 0.9, "stable"), ("gan", 0.1, "accelerating")], "concept_name string, composite_score double, trend string")
    got = {r.concept_key: (r.concept_name, r.display_name, r.max_score) for r in signals.dedup_case(df).collect()}
    assert got == {"deep learning": ("Deep Learning", "Deep Learning", 1.0), "gan": ("gan", "Gan", 1.0)}
    assert {(r.trend, r.n) for r in signals.trend_counts(df).collect()} == {("stable", 2), ("accelerating", 1), ("decelerating", 0)}


def test_token_overlap(spark):
    df = spark.createDataFrame([("deep deep nets", 0.9), ("deep graphs", 0.5), ("old nets", 0.1)], "concept_name string, composite_score double")
    got = {(r.source, r.target, r.weight) for r in graph.token_overlap_edges(df).collect()}
    assert got == {("deep deep nets", "deep graphs", 2), ("deep deep nets", "old nets", 1)}


def brandes(pairs, sources):
    """Dependency sums of all nodes from some sources, one source and node at a time."""
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    total = dict.fromkeys({x for p in pairs for x in p}, 0.0)
    for s in sources:
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for a in order:
            for b in ahead.get(a, ()):
                if b not in dist:
                    dist[b], sigma[b] = dist[a] + 1, 0.0
                    order.append(b)
                if dist[b] == dist[a] + 1:
                    sigma[b] += sigma[a]
        dep = dict.fromkeys(order, 0.0)
        for a in reversed(order):
            dep[a] = sum(sigma[a] / sigma[b] * (1 + dep[b]) for b in ahead.get(a, ()) if dist[b] == dist[a] + 1)
            if a != s:
                total[a] += dep[a]
    return total


@pytest.mark.parametrize("sizes", [{}, {"lanes": 7, "bucket_nodes": 5}, {"lanes": 1, "bucket_nodes": 9}])
def test_pivots_in_lanes_equal_brandes(spark, sizes, monkeypatch):
    """Many or few pivots at a time, nodes in one bucket or many, a hub whose edges are cut into parts, loops, repeats, unreachable nodes."""
    import random

    monkeypatch.setattr(centrality, "PART", 16)
    monkeypatch.setattr(centrality, "CHUNK", 8)
    r = random.Random(9)
    pairs = {(f"n{r.randint(0, 39)}", f"n{r.randint(0, 39)}") for _ in range(90)} | {("hub", f"n{k}") for k in range(40)} | {("n3", "hub"), ("x", "y"), ("n0", "n0")}
    df = edges(spark, [*pairs, ("x", "y"), (None, "x"), ("x", None)])
    pairs = {p for p in pairs if p[0] != p[1]}
    nodes = sorted({x for p in pairs for x in p})
    k = 2 if sizes.get("lanes") == 1 else 20
    chosen = [x.node for x in centrality.pivots(spark.createDataFrame([(x,) for x in nodes], "node string"), k, 42).collect()]
    want = brandes(pairs, chosen)
    got = scores(centrality.betweenness(df, k_samples=k, top_n=None, **sizes))
    assert got == pytest.approx({x: t / ((k - (x in chosen)) * (len(nodes) - 2)) for x, t in want.items()})
