"""The intake's state is kept by built-in functions, without a call of Python for each key."""

import datetime as dt

from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import counts
from trendloom.streaming import stream


def take_in(spark, rows, at, k=0):
    rows.write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(stream.FEED).parquet(f"{at}/in")
    query = stream.ingest_papers(source, f"{at}/papers{k}", f"{at}/counts{k}", f"{at}/cp")
    query.awaitTermination()
    return [x.operatorName for p in query.recentProgress for x in p.stateOperators]


def paper(key, **own):
    row = {"arxiv_id": key, "title": "graph", "abstract": "nets", "authors": ["A"], "categories": ["x"], "published_at": dt.datetime(2024, 3, 4), "updated_at": dt.datetime(2024, 3, 4), "pdf_url": "p", "abs_url": "a"} | own
    return tuple(row.values())


def test_keys_are_told_apart_by_built_in_functions(spark, tmp_path):
    day = F.lit(dt.datetime(2024, 3, 4))
    rows = spark.range(3000).select(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")).alias("arxiv_id"), F.lit("graph").alias("title"), F.concat(F.lit("nets "), (F.col("id") % 7).cast("string")).alias("abstract"),
                                    F.array(F.lit("A")).alias("authors"), F.array(F.lit("x")).alias("categories"), day.alias("published_at"), day.alias("updated_at"), F.lit("p").alias("pdf_url"), F.lit("a").alias("abs_url"))
    assert set(take_in(spark, rows, tmp_path)) == {"dedupe"}
    got = {r.arxiv_id: r.abstract for r in stream.read_papers(spark, f"{tmp_path}/papers0").collect()}
    assert got == {f"k{k}": f"nets {min(k % 7, (k + 2000) % 7) if k < 1000 else k % 7}" for k in range(2000)}
    whole = stream.read_papers(spark, f"{tmp_path}/papers0")
    want = {tuple(r) for r in counts.keyword_counts(text.keywords(whole), whole).collect()}
    assert {tuple(r) for r in stream.read_counts(spark, f"{tmp_path}/counts0").collect()} == want and len(want) == 2


def test_first_row_of_a_key_is_whole_whatever_is_missing_or_alike(spark, tmp_path):
    soon = dt.datetime(2024, 3, 4, 0, 0, 0, 1)
    first = [paper("1", authors=["B"]), paper("1", authors=["A", None]), paper("1", authors=["A", "a"]), paper("2", updated_at=soon), paper("2"), paper("3", title=None, abstract="graph"), paper("3", title="graph", abstract=None),
             paper(None, abstract="x"), paper(None, abstract="w"), paper("4", categories=None, published_at=None), paper("4"), paper("5"), paper("5")]
    again = [paper("1", abstract="a"), paper(None, abstract="a"), paper("6", abstract="b"), paper("6", abstract="a")]
    for k, part in enumerate((first, again)):
        take_in(spark, spark.createDataFrame(part, stream.FEED).repartition(3), tmp_path, k)
    got = [{tuple(map(str, r)) for r in stream.read_papers(spark, f"{tmp_path}/papers{k}").collect()} for k in (0, 1)]
    want = [[paper("1", authors=["A", None]), paper("2"), paper("3", title=None, abstract="graph"), paper(None, abstract="w"), paper("4", categories=None, published_at=None), paper("5")], [paper("6", abstract="a")]]
    assert got == [{tuple(map(str, r)) for r in rows} for rows in want]
