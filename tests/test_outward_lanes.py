"""The search outwards carries no dependencies: their lanes come with the way back."""

from pyspark.sql import functions as F

from trendloom.operators import centrality


def test_levels_outwards_have_no_dependencies(spark, monkeypatch):
    levels, stored = [], centrality.materialize
    monkeypatch.setattr(centrality, "materialize", lambda df, name: [out := stored(df, name), name == "level" and levels.append(out)][0])
    chain = [(f"n{k}", f"n{k + 1}") for k in range(4)]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "src string, dst string")
    got = {r.concept_name: r.centrality_score for r in centrality.betweenness(edges, bucket_nodes=2).collect()}
    assert {k: round(v * 12, 9) for k, v in got.items()} == {"n0": 0, "n1": 6, "n2": 8, "n3": 6, "n4": 0}
    bytes_of = [[x.n for x in df.select(F.octet_length("dep").alias("n")).distinct().collect()] for df in levels]
    assert bytes_of == [[0]] * 6 + [[5 * 8]] * 3  # the start, five levels of which the last is empty, and three on the way back
    two = {r.concept_name: r.centrality_score for r in centrality.betweenness(edges.where("src = 'n1' AND dst = 'n0'")).collect()}
    assert two == {"n0": 0.0, "n1": 0.0}
