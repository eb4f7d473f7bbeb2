"""Queries on feeds, citation payloads and streams; their files are written by Spark from the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom import storage
from trendloom.plans import keyword_queries as kq
from trendloom.plans import views as v
from trendloom.plans.define import Book
from trendloom.sources import merge, papers
from trendloom.streaming import stream

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles


def feed(spark, d):
    """The documents as files of feed entries, with their whole texts but what XML 1.0 forbids; every ninth has no usable date."""
    docs = v.table(spark, d, "documents")
    plain = F.regexp_replace("text", "[^a-zA-Z]+", " ")
    legal = F.regexp_replace("text", r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    stamp = F.when(F.col("doc_id") % 9 == 0, F.lit("soon")).otherwise(F.date_format(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 300 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    address = F.format_string("http://arxiv.org/abs/2401.%07dv2", "doc_id")
    entries = docs.withColumn("_legal", legal).select(
        address.alias("id"), F.format_string("%s\ntitle", F.substring(plain, 1, 40)).alias("title"), F.expr("substring(_legal, 41)").alias("summary"),
        stamp.alias("published"), stamp.alias("updated"),
        F.array(F.struct(F.format_string("Author %d", F.col("doc_id") % 97).alias("name")), F.struct(F.lit("Second Author").alias("name"))).alias("author"),
        F.array(F.struct(F.col("lang").alias("_term")), F.struct(F.lit("").alias("_term"))).alias("category"),
        F.array(F.struct(address.alias("_href"), F.lit("alternate").alias("_rel"), F.lit("page").alias("_title")), F.struct(F.lit("http://x/pdf").alias("_href"), F.lit("related").alias("_rel"), F.lit("pdf").alias("_title"))).alias("link"))
    path = storage.fresh_path(spark, "feed")
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return papers.read_atom_feed(spark, path)


_ENTRIES = """entries AS (
  SELECT printf('2401.%07d', doc_id) AS arxiv_id, trim(replace(substr(p, 1, 40) || ' title', '  ', ' ')) AS title, ['Author ' || CAST(doc_id % 97 AS VARCHAR), 'Second Author'] AS authors, [lang] AS categories,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS published_at, 'http://x/pdf' AS pdf_url, printf('http://arxiv.org/abs/2401.%07dv2', doc_id) AS abs_url
  FROM (SELECT *, regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') AS p FROM documents) WHERE doc_id % 9 <> 0)"""


_WHOLE = r"""abstracts AS (SELECT printf('2401.%07d', doc_id) AS arxiv_id,
  trim(replace(replace(replace(replace(substr(regexp_replace(text, '[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g'), 41), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), ' '), '  ', ' '), ' ') AS abstract,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS updated_at FROM documents WHERE doc_id % 9 <> 0)"""


@query(f"WITH {_ENTRIES}, {_WHOLE} SELECT * FROM entries JOIN abstracts USING (arxiv_id)")
def feed_papers(spark, d):
    """All columns of the feed, with whole abstracts."""
    return feed(spark, d)


@query(f"WITH {_WHOLE} SELECT * FROM abstracts")
def feed_abstracts(spark, d):
    return feed(spark, d).select("arxiv_id", "abstract", "updated_at")


@query(f"WITH {_ENTRIES} SELECT arxiv_id, published_at FROM entries WHERE published_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-06-01'")
def feed_date_range(spark, d):
    return papers.filter_published(feed(spark, d), dt.datetime(2024, 3, 1), dt.datetime(2024, 6, 1)).select("arxiv_id", "published_at")


def payloads(spark, d):
    """An order as a paper: its parts cite it or are its references, its suppliers are the authors; some lack ids."""
    lines = v.table(spark, d, "lineitem")
    part = F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_partkey").cast("string")).alias("paperId"))
    author = F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_suppkey").cast("string")).alias("authorId"), F.when(F.col("l_suppkey") % 4 != 0, F.format_string("S%d", "l_suppkey")).alias("name"))
    cited = F.col("l_returnflag") == "A"
    orders = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(cited, part)).alias("citations"), F.collect_list(F.when(~cited, part)).alias("references"), F.collect_list(author).alias("authors"))
    body = F.to_json(F.struct(F.format_string("ss-%d", "l_orderkey").alias("paperId"), F.lit(2024).alias("year"), "authors", "citations", "references"))
    return orders.select(F.col("l_orderkey").cast("string").alias("arxiv_id"), body.alias("payload"))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_arxiv_id, CAST(l_partkey AS VARCHAR) AS cited_paper_id, CASE WHEN l_returnflag = 'A' THEN 'citation' ELSE 'reference' END AS citation_type
FROM lineitem WHERE l_linenumber <> 3""")
def citation_rows(spark, d):
    return papers.citation_rows(papers.parse_citation_payloads(payloads(spark, d)))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_suppkey AS VARCHAR) AS author_id, CASE WHEN l_suppkey % 4 <> 0 THEN 'S' || CAST(l_suppkey AS VARCHAR) ELSE '' END AS author_name FROM lineitem WHERE l_linenumber <> 2")
def author_rows(spark, d):
    return papers.author_rows(papers.parse_citation_payloads(payloads(spark, d)))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS arxiv_id, 'ss-' || CAST(l_orderkey AS VARCHAR) AS semantic_scholar_id, 2024 AS year FROM lineitem")
def citation_stamps(spark, d):
    """Papers stamped with the id of their payload."""
    parsed = papers.parse_citation_payloads(payloads(spark, d)).select("arxiv_id", "semantic_scholar_id", "year")
    bare = parsed.select("arxiv_id", F.lit(None).cast("string").alias("semantic_scholar_id"), F.lit(None).cast("int").alias("year"))
    return merge.update_columns(bare, parsed, ["arxiv_id"])


def _stream(spark, d, name):
    """The table as a stream of files, whether it is one file or a folder."""
    return spark.readStream.schema(v.table(spark, d, name).schema).option("recursiveFileLookup", "true").parquet(f"{d}/{name}*.parquet")


def _ingested(spark, d):
    """The documents taken in as a stream of papers with all their columns: the folders of papers and counts."""
    docs = _stream(spark, d, "documents")
    day = F.expr("timestamp'2022-01-01' + make_interval(0, 0, 0, cast(doc_id % 1096 as int))")
    rows = docs.select(
        F.format_string("2401.%07d", "doc_id").alias("arxiv_id"), F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("abstract"),
        F.array(F.format_string("Author %d", F.col("doc_id") % 97)).alias("authors"), F.array("lang", "source").alias("categories"), day.alias("published_at"),
        (day + F.expr("interval 1 day")).alias("updated_at"), F.format_string("http://x/pdf/%d", "doc_id").alias("pdf_url"), F.format_string("http://x/abs/%d", "doc_id").alias("abs_url"))
    at = storage.fresh_path(spark, "intake")
    stream.ingest_papers(rows, f"{at}/papers", f"{at}/counts", f"{at}/checkpoint").awaitTermination()
    return f"{at}/papers", f"{at}/counts"


@query(f"WITH {kq._COUNTS} SELECT * FROM counts")
def stream_ingest(spark, d):
    """Counts of papers taken in by the stream: those of the batch."""
    return stream.read_counts(spark, _ingested(spark, d)[1])


@query(f"""WITH {v.PAPERS} SELECT arxiv_id, title, abstract, ['Author ' || CAST(id % 97 AS VARCHAR)] AS authors, categories, published_at, published_at + INTERVAL 1 DAY AS updated_at,
  'http://x/pdf/' || CAST(id AS VARCHAR) AS pdf_url, 'http://x/abs/' || CAST(id AS VARCHAR) AS abs_url FROM papers""")
def stream_papers(spark, d):
    """Papers taken in by the stream, each once and whole."""
    return stream.read_papers(spark, _ingested(spark, d)[0])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def read_table(spark, d):
    return papers.read_table(spark, "orders", d).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT 'customer' AS name, c_custkey AS id, c_name AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
UNION ALL SELECT 'documents', doc_id, text FROM documents""")
def snapshot_tables(spark, d):
    """Tables as they are read again from a snapshot."""
    keys = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "documents": ("doc_id", "text")}
    at = storage.fresh_path(spark, "snapshots")
    papers.snapshot({name: papers.read_table(spark, name, d) for name in keys}, at, "2024-01-01")
    parts = [papers.read_table(spark, name, f"{at}/2024-01-01").select(F.lit(name).alias("name"), F.col(k).cast("long").alias("id"), F.col(x).alias("value")) for name, (k, x) in keys.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH w AS (
  SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS window_start, event_type AS keyword, 'u' || CAST(user_id % 4 AS VARCHAR) AS category, count(*) AS count FROM events GROUP BY ALL)
SELECT * FROM w WHERE window_start + INTERVAL 7 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 7 DAY FROM events)""")
def stream_windowed_counts(spark, d):
    """Weeks that the watermark has closed."""
    events = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("keyword"), F.format_string("u%d", F.col("user_id") % 4).alias("category"), F.lit(1).cast("long").alias("count"))
    at = storage.fresh_path(spark, "weeks")
    sink = stream.windowed_counts(events).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start timestamp, keyword string, category string, count bigint").parquet(f"{at}/rows")
