"""No exported JSON text grows with the table."""

import datetime as dt
import json

from pyspark.sql import functions as F

from trendloom.operators import personal
from trendloom.plans import report_queries


def test_export_is_cut_by_papers(spark):
    n = 2 * personal.EXPORT_PAPERS + 1
    c = spark.createDataFrame([(1, p, f"c{k}", 0.5) for p in range(n) for k in range(2)], "user_id long, paper_id long, concept string, weight double")
    e = spark.createDataFrame([(1, p, "c0", "c1", 0.25) for p in range(0, n, 2)], "user_id long, paper_id long, source_concept string, target_concept string, weight double")
    got = {r.part: json.loads(r.document) for r in personal.export_json(c, e).collect()}
    assert [(k, len(got[k]["concepts"]), len(got[k]["edges"])) for k in sorted(got)] == [(0, 200, 50), (1, 200, 50), (2, 2, 1)]
    assert [x["paper_id"] for k in sorted(got) for x in got[k]["concepts"]] == sorted(list(range(n)) * 2)


def test_simulations_are_cut_in_parts(spark, tmp_path):
    n = 7000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": "x"}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    sizes = [r.n for r in report_queries.simulation_results(spark, str(tmp_path)).select(F.expr("size(split(results, 'persona')) - 1").alias("n")).collect()]
    assert max(sizes) == report_queries.PART and sum(sizes) == n
    per = report_queries.simulation_opinions(spark, str(tmp_path)).groupBy("result_id", "round").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in per) and sum(r.n for r in per) == n
