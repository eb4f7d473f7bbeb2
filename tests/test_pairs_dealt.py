"""The pairs that one task makes don't grow in number with the table."""

from collections import Counter

from pyspark.sql import functions as F

from trendloom.operators import personal


def test_pairs_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(personal, "PAIRED", 50, raising=False)
    most = []
    for papers in (400, 1600):
        rows = spark.range(papers).select(F.col("id").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank")).withColumns({"concept": F.concat(F.lit("c"), F.col("rank").cast("string")), "weight": 1 / (F.col("rank") + 2)})
        edges = personal.concept_edges(rows)
        sizes = Counter(r.p for r in edges.select(F.spark_partition_id().alias("p")).collect())
        assert sizes.total() == papers * 190 and edges.distinct().count() == papers * 190
        most.append(max(sizes.values()))
    assert most[1] < 2 * most[0] and most[1] <= 3 * 50 * 190


def test_pairs_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    rows = [(u, p, f"c{(p * 7 + k) % 90:02d}", f"c{(p * 5 + 3 * k + 1) % 90:02d}", (k + p % 4) / 8) for p in range(300) for u in (0, 1) for k in range(6)]
    edges = spark.createDataFrame(rows, "user_id long, paper_id long, source_concept string, target_concept string, weight double")
    whole = {tuple(r) for r in personal.top_pairs(edges).collect()}
    dealt, plain = [], type(edges).repartition
    monkeypatch.setattr(personal, "GROUPED", 100, raising=False)
    monkeypatch.setattr(type(edges), "repartition", lambda df, n, *by: dealt.append((n, by)) or plain(df, n, *by))
    assert {tuple(r) for r in personal.top_pairs(edges).collect()} == whole and len(whole) == 30
    assert dealt == [(36, ("user_id", "concept_a", "concept_b"))]
