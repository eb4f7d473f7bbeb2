"""Feeds, payloads, merges, search and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendloom.operators import corpus, counts, signals, similarity
from trendloom.functions import text
from trendloom.sources import merge, papers
from trendloom.streaming import stream

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2309.11111v3</id><title>  On the shape
of rivers </title><summary>Water runs
downhill</summary><published>2023-09-20T06:00:00Z</published><updated>2023-10-02T00:00:00Z</updated>
<author><name>Noor Vale</name></author><author><name>Ines Okoro</name></author>
<category term="physics.geo-ph"/><category term="math.DS"/><link href="http://x/abs" rel="alternate"/><link href="http://x/pdf" rel="related" title="pdf"/></entry>
<entry><id>http://arxiv.org/abs/2309.22222v1</id><title>Lone</title><summary>s</summary><published>2023-09-05T00:00:00Z</published><author><name>Teo</name></author><category term=""/></entry>
<entry><id>http://arxiv.org/abs/2309.33333v1</id><title>No date</title><summary>s</summary><published>soon</published></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    df = papers.read_atom_feed(spark, str(tmp_path / "feed.xml"))
    got = {r.arxiv_id: r for r in df.collect()}
    assert set(got) == {"2309.11111", "2309.22222"}
    one = got["2309.11111"]
    assert (one.title, one.abstract, one.authors, one.categories) == ("On the shape of rivers", "Water runs downhill", ["Noor Vale", "Ines Okoro"], ["physics.geo-ph", "math.DS"])
    assert (one.pdf_url, one.abs_url) == ("http://x/pdf", "http://x/abs")
    assert got["2309.22222"].categories == [] and got["2309.22222"].authors == ["Teo"]
    assert papers.filter_published(df, dt.datetime(2023, 9, 10)).count() == 1
    assert papers.filter_published(df, dt.datetime(2023, 9, 1), dt.datetime(2023, 9, 5)).count() == 1


def test_citation_payload(spark):
    payload = '{"paperId":"s2-77","year":2019,"authors":[{"authorId":"w9","name":"Noor"},{"name":"x"}],"citations":[{"paperId":"late-a"},{"paperId":"late-b"},{}],"references":[{"paperId":"early"}]}'
    parsed = papers.parse_citation_payloads(spark.createDataFrame([("p", payload), ("q", "{}")], "arxiv_id string, payload string"))
    rows = papers.citation_rows(parsed)
    assert sorted((r.cited_paper_id, r.citation_type) for r in rows.collect()) == [("early", "reference"), ("late-a", "citation"), ("late-b", "citation")]
    assert [(r.author_id, r.author_name) for r in papers.author_rows(parsed).collect()] == [("w9", "Noor")]
    assert merge.insert_ignore(rows, rows, ["source_arxiv_id", "cited_paper_id", "citation_type"]).count() == 3
    assert {r.semantic_scholar_id for r in parsed.collect()} == {"s2-77", ""}


def test_merges(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    b = spark.createDataFrame([("b", 5), ("c", 7), ("c", 7)], "k string, n long")
    rows = lambda df: sorted((r.k, r.n) for r in df.collect())
    assert rows(merge.insert_ignore(t, b, ["k"])) == [("a", 1), ("b", 2), ("c", 7)]
    counted = merge.insert_counts(t, b, ["k"]).first()
    assert (counted["new"], counted["skipped"]) == (1, 2)
    once = merge.insert_ignore(t, b, ["k"])
    assert merge.insert_counts(once, b, ["k"]).first()["new"] == 0
    assert rows(merge.accumulate(t, b, ["k"], ["n"])) == [("a", 1), ("b", 7), ("c", 14)]
    assert rows(merge.replace(t, b, ["k"])) == [("a", 1), ("b", 5), ("c", 7)]
    assert rows(merge.update_columns(t, b, ["k"])) == [("a", 1), ("b", 5)]


def test_repeated_keys_leave_one_row_each(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], "k string, n long, s string")
    b = spark.createDataFrame([("b", 9, "u", 1), ("b", 6, None, 2), ("c", 7, "v", 1), ("c", 8, "w", 1), (None, 5, None, 1)], "k string, n long, s string, seq int")
    rows = lambda df: sorted(map(str, df.select("k", "n", "s").collect()))
    same = lambda *x: sorted(str(r) for r in spark.createDataFrame(list(x), "k string, n long, s string").collect())
    assert rows(merge.replace(t, b, ["k"], ["seq"])) == same(("a", 1, "x"), ("b", 6, None), ("c", 8, "w"), (None, 5, None))
    assert rows(merge.replace(t, b.drop("seq"), ["k"])) == same(("a", 1, "x"), ("b", 9, "u"), ("c", 8, "w"), (None, 5, None))
    assert rows(merge.update_columns(t, b, ["k"], ["seq"])) == same(("a", 1, "x"), ("b", 6, "u"), (None, 5, "z"))  # a null leaves what was set before
    assert merge.replace(t, b, ["k"], ["seq"]).columns == merge.update_columns(t, b, ["k"], ["seq"]).columns == t.columns
    assert rows(merge.insert_ignore(t, b.drop("seq"), ["k"])) == same(("a", 1, "x"), ("b", 2, None), (None, 3, "z"), ("c", 7, "v"))


@pytest.mark.parametrize("buckets", [0, 4])
def test_merges_touch_their_partitions_alone(spark, tmp_path, buckets):
    path = f"{tmp_path}/t"
    schema = "k long, n long, p int"
    laid = (lambda df: merge.with_bucket(df.drop("p"), ["k"], buckets, "p")) if buckets else lambda df: df
    old = laid(spark.createDataFrame([(k, k, k % 3) for k in range(30)], schema))
    assert merge.merge_into(spark, path, old, "p", lambda t, b: merge.replace(t, b, ["k"])) == sorted({r.p for r in old.collect()})
    before = files(tmp_path / "t")
    new = laid(spark.createDataFrame([(3, 100, 0), (3, 101, 0)], schema))
    [touched] = merge.merge_into(spark, path, new, "p", lambda t, b: merge.replace(t, b, ["k"], ["n"]))
    now = files(tmp_path / "t")
    assert {f: x for f, x in before.items() if f"p={touched}/" not in f} == {f: x for f, x in now.items() if f"p={touched}/" not in f} and before != now
    got = lambda: {r.k: r.n for r in merge.read_partitions(spark, path, old.schema, "p").collect()}
    assert got() == {k: k for k in range(30)} | {3: 101}
    stamps = laid(spark.createDataFrame([(3, 7, 0), (4, 8, 1), (99, 1, 0)], schema))
    for _ in range(2):  # a run that is repeated gives the same rows
        merge.merge_into(spark, path, stamps, "p", lambda t, b: merge.update_columns(t, b, ["k", "p"]), old.schema)
        assert got() == {k: k for k in range(30)} | {3: 7, 4: 8}
    merge.merge_into(spark, path, new, "p", lambda t, b: merge.accumulate(t, b, ["k", "p"], ["n"]))
    assert got() == {k: k for k in range(30)} | {3: 208, 4: 8}
    assert merge.merge_into(spark, path, new.where("false"), "p", lambda t, b: merge.replace(t, b, ["k"])) == []
    plan = merge.read_partitions(spark, path, old.schema, "p", [touched])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_months_outside_of_a_range_are_not_read(spark, tmp_path):
    rows = [(k, f"p{k}", dt.datetime(2024, 1 + k % 12, 1 + k % 28)) for k in range(100)] + [(200, "none", None)]
    p = spark.createDataFrame(rows, "id long, arxiv_id string, published_at timestamp")
    papers.write_by_month(p, f"{tmp_path}/p")
    assert len(list((tmp_path / "p").glob("month=*"))) == 13
    stored = spark.read.schema(papers.by_month(p).schema).parquet(f"{tmp_path}/p")
    start, end = dt.datetime(2024, 3, 5), dt.datetime(2024, 5, 1)
    found = corpus.published_between(stored, start, end)
    assert sorted(r.id for r in found.collect()) == sorted(k for k, _, t in rows if t and start <= t < end)
    assert sorted(r.id for r in papers.filter_published(stored, start).collect()) == sorted(k for k, _, t in rows if t and start <= t)

    def filters(df):
        df.collect()
        return [x.split("]")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]]

    assert all("month" in x for x in filters(found))
    mentions = papers.by_month(p).select("arxiv_id", "month", F.lit("c").alias("concept_name"))
    mentions.write.partitionBy("month").parquet(f"{tmp_path}/m")
    mentions = spark.read.schema(mentions.schema).parquet(f"{tmp_path}/m")
    counted = signals.mention_counts(stored, mentions, start, end)
    assert counted.first().mentions == found.count() and all("month" in x for x in filters(counted))
    windows = corpus.papers_by_month(stored, corpus.month_windows(spark, start, end))
    assert sum(r.n for r in windows.collect()) == sum(t is not None and start <= t <= end for *_, t in rows)
    assert any("dynamicpruning" in x for x in filters(windows))


def test_snapshot_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "p string, n long")
    papers.snapshot({"t": df}, str(tmp_path), "s1")
    assert papers.read_table(spark, "t", f"{tmp_path}/s1").count() == 2
    merge.write_partitions(df, f"{tmp_path}/parts", "p")
    merge.write_partitions(spark.createDataFrame([("y", 9)], "p string, n long"), f"{tmp_path}/parts", "p")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/parts").collect()) == [1, 9]


def test_search(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "paper_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.paper_id, round(r.score, 6)) for r in similarity.nearest(emb, q, 5, 0.7).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.8)]
    assert similarity.nearest(emb.where("paper_id > 2"), q, 5, 0.7).count() == 0


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 200}, {"block_bytes": 200, "most_blocks": 1}])
def test_search_in_place_in_blocks_and_in_tiles(spark, settings, monkeypatch, tmp_path):
    """All forms give the rows of a plain search; only tiles move vectors of the corpus."""
    import numpy as np

    monkeypatch.setattr(similarity, "TILE", 40)
    r = np.random.default_rng(0)
    vectors = r.standard_normal((300, 6)).astype(np.float32)
    vectors[200:] = vectors[:100]  # ties
    vectors[7] = 0
    emb = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(999, None)], "paper_id long, embedding array<float>")
    emb.repartition(5).write.parquet(f"{tmp_path}/emb")
    emb = spark.read.parquet(f"{tmp_path}/emb")
    q = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(0, 40, 3)] + [(77, None)], "query_id long, embedding array<float>")
    found = similarity.nearest(emb, q, 4, 0.2, **settings)
    unit = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-300)
    want = []
    for k in range(0, 40, 3):
        s = np.round(unit @ unit[k], 9)
        best = sorted((-s[j], j) for j in range(300) if s[j] >= 0.2)[:4]
        want += [(k, i + 1, j, -x) for i, (x, j) in enumerate(best)]
    assert sorted((x.query_id, x["rank"], x.paper_id, round(x.score, 9)) for x in found.collect()) == sorted(want)
    moved = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    if settings.get("most_blocks") != 1:
        assert moved and all("hashpartitioning(query_id" in x for x in moved)  # the best of each task, without vectors
    none = spark.createDataFrame([], q.schema)
    assert similarity.nearest(emb, none, 4, 0.2, **settings).count() == 0 and similarity.nearest(emb.where("false"), q, 4, 0.2, **settings).count() == 0


def test_embedding_takes_abstracts_and_keeps_failures_apart(spark):
    rows = [(k, "title", f"abstract {k}") for k in range(100)] + [(100, "t", None), (101, "t", ""), (102, "bad title", "fine")]
    p = spark.createDataFrame(rows, "id long, title string, abstract string").repartition(3)
    emb = spark.createDataFrame([(3, [1.0])], "paper_id long, embedding array<float>")

    def embed(texts):
        assert not any("title" in t for t in texts)
        if any(t.endswith("13") or t.endswith("14") or t.endswith("77") for t in texts):
            raise RuntimeError("no")
        if any(t.endswith("50") for t in texts):
            return [[1.0]] * (len(texts) + 1)
        return [None if t.endswith("9") else [float(len(t))] for t in texts]

    out = similarity.embed_pending(p, emb, embed)
    got = {r.paper_id: r.embedding for r in out.collect()}
    bad = {13, 14, 77, 50, 100} | {k for k in range(100) if k % 10 == 9}
    assert set(got) == set(range(103)) - {3} and {k for k, v in got.items() if v is None} == bad and got[102] == [4.0] and got[101] == [0.0]
    r = similarity.embed_counts(out).first()
    assert (r.embedded, r.skipped) == (102 - len(bad), len(bad))
    assert similarity.embed_pending(p, emb, embed, limit=5).count() == 5


def paper(key, abstract="nets", categories=("x",)):
    day = dt.datetime(2024, 3, 4)
    return (key, "graph", abstract, ["An Author"], list(categories), day, day, "http://x/pdf", "http://x/abs")


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_stream_equals_batch_and_counts_new_papers_once(spark, tmp_path):
    batches = [[paper("1"), paper("1")], [paper("1"), paper("2", "", ())], [paper("3", "rivers"), paper("2")]]
    seen = {}
    for part in batches:
        spark.createDataFrame(part, stream.FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(stream.FEED).parquet(f"{tmp_path}/in")
        stream.ingest_papers(source, f"{tmp_path}/papers", f"{tmp_path}/counts", f"{tmp_path}/cp").awaitTermination()
        now = files(tmp_path / "papers") | files(tmp_path / "counts")
        assert seen.items() <= now.items()  # nothing written before is written again
        seen = now
    got = stream.read_papers(spark, f"{tmp_path}/papers")
    assert sorted(tuple(r) for r in got.collect()) == [paper("1"), paper("2", "", ()), paper("3", "rivers")]
    want = {tuple(r) for r in counts.keyword_counts(text.keywords(got), got).collect()}
    assert {tuple(r) for r in stream.read_counts(spark, f"{tmp_path}/counts").collect()} == want
    stream.compact_counts(spark, f"{tmp_path}/counts")
    assert (tmp_path / "counts" / "upto=1" / "_SUCCESS").exists()
    assert {tuple(r) for r in stream.read_counts(spark, f"{tmp_path}/counts").collect()} == want
    stream.compact_counts(spark, f"{tmp_path}/counts")
    assert len(list((tmp_path / "counts").glob("upto=*"))) == 1
    stream.compact_papers(spark, f"{tmp_path}/papers")
    assert sorted(tuple(r) for r in stream.read_papers(spark, f"{tmp_path}/papers").collect()) == [paper("1"), paper("2", "", ()), paper("3", "rivers")]
    assert (tmp_path / "papers" / "upto=1" / "_SUCCESS").exists()


def test_a_batch_reads_no_older_papers(spark, tmp_path):
    """What was seen is the stream's state: nothing is read from the tables, which may be gone; the session's settings stay."""
    settings = dict(spark.conf.getAll)
    for k, part in enumerate([[paper("1"), paper("2")], [paper("2", "later"), paper("3", "b"), paper("3", "a"), paper(None), paper("1")]]):
        spark.createDataFrame(part, stream.FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(stream.FEED).parquet(f"{tmp_path}/in")
        stream.ingest_papers(source, f"{tmp_path}/papers{k}", f"{tmp_path}/counts{k}", f"{tmp_path}/cp").awaitTermination()
    got = [sorted(((r.arxiv_id or "", r.abstract) for r in stream.read_papers(spark, f"{tmp_path}/papers{k}").collect())) for k in (0, 1)]
    assert got == [[("1", "nets"), ("2", "nets")], [("", "nets"), ("3", "a")]]
    assert dict(spark.conf.getAll) == settings


def test_batch_that_runs_again_leaves_the_same_tables(spark, tmp_path):
    for part in ([paper("1")], [paper("1"), paper("2")]):
        spark.createDataFrame(part, stream.FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(stream.FEED).parquet(f"{tmp_path}/in")
        stream.ingest_papers(source, f"{tmp_path}/papers", f"{tmp_path}/counts", f"{tmp_path}/cp").awaitTermination()
    rows = lambda: (sorted(r.arxiv_id for r in stream.read_papers(spark, f"{tmp_path}/papers").collect()), sorted(map(str, stream.read_counts(spark, f"{tmp_path}/counts").collect())))
    before = rows()
    (tmp_path / "cp" / "commits" / "1").unlink()  # as if the driver was lost after the batch's writes
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    (tmp_path / "counts" / "batch=1" / "_SUCCESS").unlink()
    source = spark.readStream.schema(stream.FEED).parquet(f"{tmp_path}/in")
    stream.ingest_papers(source, f"{tmp_path}/papers", f"{tmp_path}/counts", f"{tmp_path}/cp").awaitTermination()
    assert rows() == before and before[0] == ["1", "2"]


def test_jdbc_table_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(k, f"n{k}") for k in range(1, 41)]
    spark.createDataFrame(rows, "ID int, NAME string").write.jdbc(url, "PEOPLE", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": "NAME VARCHAR(20)"})
    df = papers.read_jdbc(spark, url, "PEOPLE", "ID", 4, {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert df.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in df.collect()) == rows


def test_grounding_gives_every_direction_a_context(spark):
    about = spark.createDataFrame([(1, "p1", "Rivers", "How water runs", dt.datetime(2024, 1, 2)), (2, "p2", "Hills", "How land stands", dt.datetime(2024, 1, 3))], "id long, arxiv_id string, title string, abstract string, published_at timestamp")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "paper_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, "geo", "floods"), (8, "geo", "far away"), (9, "geo", None)], "query_id long, topic string, direction string")
    vectors = spark.createDataFrame([(7, [0.9, 0.1]), (8, [-1.0, 0.0]), (9, None)], "query_id long, embedding array<float>")
    got = {r.query_id: (r["query"], r.block) for r in similarity.ground(asked, vectors, emb, about).collect()}
    assert got == {7: ("geo: floods", "[1] Rivers (2024-01-02) — How water runs"), 8: ("geo: far away", ""), 9: ("geo: ", "")}
    blocks = spark.createDataFrame([(7, "[1] Rivers")], "query_id long, block string")
    prompts = {r.query_id: r.prompt for r in text.grounded_prompt(spark.createDataFrame([(7, "floods grow"), (8, None)], "query_id long, text string"), blocks, "prediction").collect()}
    assert prompts[7].endswith("Sources:\n[1] Rivers\n\nPrediction to analyse:\nfloods grow") and prompts[8].endswith("Sources:\n\n\nPrediction to analyse:\n")


def test_windowed_counts_start_on_monday(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 5), "k", "c", 2), (dt.datetime(2024, 1, 7, 23), "k", "c", 3), (dt.datetime(2024, 1, 8), "k", "c", 4), (dt.datetime(2024, 3, 1), "z", "c", 1)]
    schema = "ts timestamp, keyword string, category string, count long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = stream.windowed_counts(source).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    got = {(r.window_start, r["count"]) for r in spark.table("weeks").where(F.col("keyword") == "k").collect()}
    assert got == {(dt.datetime(2024, 1, 1), 5), (dt.datetime(2024, 1, 8), 4)}
