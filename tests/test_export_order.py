"""Exported edges are rounded without decimals, to the same numbers, and come in order before they are sorted."""

import json
import random

from pyspark.sql import functions as F

from trendloom.operators import personal


def test_plain_rounding_is_that_of_decimals(spark):
    r = random.Random(2)
    xs = [r.random() ** r.choice([1, 3, 8]) * r.choice([1, -1, 1000]) for _ in range(4000)]
    xs += [a / 128 for a in range(-300, 300)] + [(k + 0.5) / 1e6 for k in range(-200, 2000)] + [k / 1e6 for k in range(300)]
    xs += [x + d for x in (0.0000005, 0.1234565, 2.0000015) for d in (1e-13, -1e-13, 1e-12, 2e-12, -2e-12)] + [1e3, 999.9999995, 1e9, 1e15 + 0.5, 1e300, -1e-9, 0.0, -0.0, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", personal._rounded(F.col("x")).alias("got"), F.round("x", 6).alias("want"))
    bad = [r for r in rows.collect() if not (r.got == r.want or str(r.got) == str(r.want))]
    assert not bad


def test_edges_are_made_in_order_and_hardly_use_decimals(spark, monkeypatch):
    names = [f"c{k:02d}" for k in range(20)]
    random.Random(4).shuffle(names)
    rows = [(1, 7, c, 1 / (k + 3), k + 1) for k, c in enumerate(names)] + [(1, 8, "b", 0.5, 1), (1, 8, "a", 0.25, 2), (1, 8, "b", 0.125, 3), (1, 8, "c", 0.0625, 4)]
    seen, stored = {}, personal.materialize
    monkeypatch.setattr(personal, "materialize", lambda df, name: seen.setdefault(name, stored(df, name)))
    df = personal.export_graphs(spark.createDataFrame(rows, "user_id long, paper_id long, concept string, weight double, rank int"))
    assert [x.concept for x in seen["export-papers"].where("paper_id = 7").first().best] == sorted(names)
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()  # decimals only where a product is near a half
    edges = json.loads(df.first().document)["edges"]
    keys = [(e["paper_id"], e["source_concept"], e["target_concept"], e["weight"]) for e in edges]
    assert keys == sorted(keys) and len(keys) == 190 + 6
    rank, weight = {c: k for k, c in enumerate(names)}, {c: 1 / (k + 3) for k, c in enumerate(names)}
    want = {(a, b): weight[a] * weight[b] for a in names for b in names if rank[a] < rank[b]}
    assert {(a, b) for p, a, b, _ in keys if p == 7} == set(want) and all(abs(w - want[a, b]) < 5.001e-7 for p, a, b, w in keys if p == 7)
    assert [k[1:] for k in keys if k[0] == 8] == [("a", "b", 0.03125), ("a", "c", 0.015625), ("b", "a", 0.125), ("b", "b", 0.0625), ("b", "c", 0.007813), ("b", "c", 0.03125)]
