"""An export reads its texts once and makes no row for an edge."""

import json

from pyspark.sql import functions as F

from trendloom.operators import personal
from trendloom.plans import user_queries


def documents(df):
    return {(r.user_id, r.part): json.loads(r.document) for r in df.collect()}


def test_lists_of_papers_give_the_same_documents(spark):
    rows = [(p % 3 if p % 11 else None, p, f"c{(k * 7 + p) % 30}", (k + 1) / (p + 40), k + 1) for p in range(450) for k in range(p % 25)]
    rows += [(1, None, "x", 0.5, 1), (1, None, "y", 0.25, 2), (2, 900, "alone", 1.0, 1)]
    c = spark.createDataFrame(rows, "user_id long, paper_id long, concept string, weight double, rank int").repartition(5)
    links = personal.concept_edges(c.where("paper_id IS NOT NULL")).join(c.select("paper_id", "user_id").distinct(), "paper_id")
    got, apart = documents(personal.export_graphs(c)), documents(personal.export_json(c, links))
    extra = got[1, 0]["edges"].pop(0)
    assert extra == {"source_concept": "x", "target_concept": "y", "weight": 0.125} and got == apart
    assert sum(len(x["concepts"]) for x in got.values()) == len(rows) and max(len({y.get("paper_id") for y in x["concepts"]}) for x in got.values()) <= personal.EXPORT_PAPERS
    assert {k: len(x["concepts"]) for k, x in got.items() if k[0] is None} and (2, 0) in got
    only = documents(personal.export_json(c.limit(0), links.where("user_id = 2")))
    assert all(not x["concepts"] for x in only.values()) and sum(len(x["edges"]) for x in only.values()) == links.where("user_id = 2").count()


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: read.add(1) or x).asNondeterministic()
    spark.createDataFrame([(k, f"graph nets river w{'abc'[k % 3] * 3}", "en", "s") for k in range(40)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain = user_queries.v.user_documents
    monkeypatch.setattr(user_queries.v, "user_documents", lambda s, d: plain(s, d).withColumn("text", count("text")))
    for name in ("user_export_rows", "user_export_json"):
        read.value = 0
        rows = getattr(user_queries, name)(spark, str(tmp_path)).collect()
        assert read.value == 40 and len(rows) == (40 * (4 + 6) if name == "user_export_rows" else 40)
