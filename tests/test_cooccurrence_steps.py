"""Co-occurrence edges kept up to date by runs that make pairs of new papers alone."""

import datetime as dt

from pyspark.sql import functions as F

from trendloom.operators import graph

PAPERS = "arxiv_id string, cooccurrence_processed_at timestamp"
DAYS = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_runs_add_up_to_the_full_build(spark, tmp_path):
    found = spark.createDataFrame([(f"p{k}", f"c{(k * j) % 17}") for k in range(40) for j in (1, 2, 3, 5)], "arxiv_id string, concept_name string")
    papers = spark.createDataFrame([(f"p{k}", None) for k in range(40)], PAPERS)
    first = papers.where("arxiv_id < 'p3'")
    path = f"{tmp_path}/edges"
    one = graph.extend_cooccurrence(spark, path, found, first, DAYS[0], 8)
    assert rows(graph.stored_cooccurrence(spark, path)) == rows(graph.cooccurrence(found, first))
    assert {r.cooccurrence_processed_at for r in one.collect()} == {DAYS[0]}
    before = files(tmp_path / "edges")
    both = one.union(papers.join(one, "arxiv_id", "left_anti"))
    two = graph.extend_cooccurrence(spark, path, found, both, DAYS[1], 8)
    assert before.items() <= files(tmp_path / "edges").items()  # nothing is written again
    assert rows(graph.stored_cooccurrence(spark, path)) == rows(graph.cooccurrence(found))
    assert two.groupBy("cooccurrence_processed_at").agg(F.count("*").alias("n")).count() == 2
    after = files(tmp_path / "edges")
    graph.extend_cooccurrence(spark, path, found, both, DAYS[1], 8)  # as if the stamps were lost
    assert rows(graph.stored_cooccurrence(spark, path)) == rows(graph.cooccurrence(found)) and set(files(tmp_path / "edges")) - set(after) == set()
    graph.extend_cooccurrence(spark, path, found, two, DAYS[1], 8)
    assert files(tmp_path / "edges") == after
    none = spark.createDataFrame([], "src string, rel string, dst string")
    known, stamped = graph.add_cooccurrence(none, found, first, DAYS[0])
    assert rows(graph.add_cooccurrence(known, found, stamped.union(papers.join(stamped, "arxiv_id", "left_anti")), DAYS[1])[0]) == rows(graph.cooccurrence(found))
