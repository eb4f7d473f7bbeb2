"""The library's tables derived from the driver's, in Spark and in SQL side by side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.text import DOCUMENT_STOPWORDS, STOPWORDS

#: "Now" of the series derived from events, and of those derived from documents.
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
PAPERS_AS_OF = dt.datetime(2024, 10, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.format_string("2401.%07d", "doc_id").alias("arxiv_id"), F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("abstract"), F.array("lang", "source").alias("categories"),
        F.expr("timestamp'2022-01-01' + make_interval(0, 0, 0, cast(doc_id % 1096 as int))").alias("published_at"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN timestamp'2024-12-01' END").alias("graph_processed_at"))


PAPERS = """papers AS (
  SELECT doc_id AS id, printf('2401.%07d', doc_id) AS arxiv_id, substr(text, 1, 80) AS title, substr(text, 81) AS abstract, [lang, source] AS categories,
         TIMESTAMP '2022-01-01' + to_days(CAST(doc_id % 1096 AS INTEGER)) AS published_at,
         CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-12-01' END AS graph_processed_at
  FROM documents)"""


def _ranked(name: str, rows: str, key: str, text: str, stopwords: list[str]) -> str:
    return f"""{name}_tok AS (
  SELECT {key}, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-zA-Z]{{3,}}') AS w FROM {rows})),
{name}_cnt AS (
  SELECT {key}, token, count(*) AS n, min(pos) AS p FROM {name}_tok WHERE token NOT IN ({_quoted(stopwords)}) GROUP BY ALL),
{name}_ranked AS (
  SELECT {key}, token, n, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, p) AS rank, sum(n) OVER (PARTITION BY {key}) AS total FROM {name}_cnt)"""


#: The keywords of all papers, ranked: kw_ranked(arxiv_id, token, n, rank, total).
KEYWORDS = PAPERS + ",\n" + _ranked("kw", "papers", "arxiv_id", "coalesce(title, '') || ' ' || coalesce(abstract, '')", STOPWORDS)


def user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % 50).alias("user_id"), "text")


#: Weighted concepts of all documents: concepts(paper_id, user_id, concept, weight, rank), 50 each.
CONCEPTS = "docs AS (SELECT doc_id AS paper_id, text FROM documents),\n" + _ranked("wc", "docs", "paper_id", "text", DOCUMENT_STOPWORDS) + """,
concepts AS (
  SELECT paper_id, paper_id % 50 AS user_id, token AS concept, n / CAST(total AS DOUBLE) AS weight, rank FROM wc_ranked WHERE rank <= 50)"""


def dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword counts per day: keyword is the event's type, category its user's group."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("keyword"), F.format_string("u%d", F.col("user_id") % 4).alias("category"), F.date_trunc("day", "ts").alias("window_date")).agg(F.count("*").alias("count"))


DENSE = """kc AS (
  SELECT event_type AS keyword, 'u' || CAST(user_id % 4 AS VARCHAR) AS category, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_date, count(*) AS count
  FROM events GROUP BY ALL)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("source_arxiv_id"), F.col("l_partkey").cast("string").alias("cited_paper_id"),
        F.when(F.col("l_returnflag") == "A", "citation").otherwise("reference").alias("citation_type")).distinct()


CITATIONS = """citations AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_arxiv_id, CAST(l_partkey AS VARCHAR) AS cited_paper_id,
         CASE WHEN l_returnflag = 'A' THEN 'citation' ELSE 'reference' END AS citation_type FROM lineitem)"""


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("2401.%07d", "doc_id").alias("paper_id"), F.format_string("a%d", F.col("doc_id") % 97).alias("author_id"), F.format_string("Author %d", F.col("doc_id") % 97).alias("author_name"))


AUTHORS = """authors AS (
  SELECT printf('2401.%07d', doc_id) AS paper_id, 'a' || CAST(doc_id % 97 AS VARCHAR) AS author_id, 'Author ' || CAST(doc_id % 97 AS VARCHAR) AS author_name FROM documents)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") == 0).alias("is_admin"), (F.col("c_custkey") % 37).alias("lifetime_uploads"),
        F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(c_custkey % 700 as int))").alias("created_at"),
        F.expr("CASE WHEN c_custkey % 17 <> 0 THEN timestamp'2024-01-01' - make_interval(0, 0, 0, cast(c_custkey % 60 as int)) END").alias("last_login"))


USERS = """users AS (
  SELECT c_custkey AS id, c_nationkey = 0 AS is_admin, c_custkey % 37 AS lifetime_uploads,
         TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS created_at,
         CASE WHEN c_custkey % 17 <> 0 THEN TIMESTAMP '2024-01-01' - to_days(CAST(c_custkey % 60 AS INTEGER)) END AS last_login
  FROM customer)"""


def user_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'processed' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN concat('/up/', o_orderkey) END").alias("upload_path"))


USER_PAPERS = """user_papers AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'processed' END AS status,
         CASE WHEN o_orderkey % 5 <> 0 THEN '/up/' || CAST(o_orderkey AS VARCHAR) END AS upload_path
  FROM orders)"""


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 200).cast("string").alias("direction"), (F.expr("(user_id div 200 + event_id div 3) % 3") + 1).cast("int").alias("round"), (F.col("event_id") % 3).cast("string").alias("persona"),
        F.expr("CASE (event_id * 7 + user_id) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("adoption_likelihood"),
        F.array("event_type", F.get_json_object("props", "$.k")).alias("key_concerns"), F.col("event_id").alias("opinion_id"))


OPINIONS = """opinions AS (
  SELECT CAST(user_id % 200 AS VARCHAR) AS direction, CAST((user_id // 200 + event_id // 3) % 3 + 1 AS INTEGER) AS round, CAST(event_id % 3 AS VARCHAR) AS persona,
         CASE (event_id * 7 + user_id) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS adoption_likelihood,
         [event_type, json_extract_string(props, '$.k')] AS key_concerns, event_id AS opinion_id
  FROM events)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding")


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of a topic that ask for context: `query_id, topic, direction`, one per fiftieth embedding."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.format_string("topic %d", F.col("vec_id") % 7).alias("topic"), F.format_string("direction %d", "vec_id").alias("direction"))


TOPICS = """directions AS (
  SELECT vec_id AS query_id, 'topic ' || CAST(vec_id % 7 AS VARCHAR) AS topic, 'direction ' || CAST(vec_id AS VARCHAR) AS direction,
         CASE WHEN vec_id % 400 <> 0 THEN embedding END AS embedding FROM embeddings WHERE vec_id % 50 = 0)"""


#: The ranking's inputs from documents: concepts by how many papers mention them, velocity from their weights.
BRIDGE = KEYWORDS + """,
bridge AS (
  SELECT token AS concept_name, CAST(count(*) AS DOUBLE) AS centrality_score FROM kw_ranked WHERE rank <= 8 GROUP BY token),
velocity AS (
  SELECT token AS concept_name, CAST(sum(n) - 3 * count(*) AS DOUBLE) AS velocity, CAST(max(n) - min(n) AS DOUBLE) AS acceleration,
         CASE WHEN sum(n) % 3 = 0 THEN 'stable' WHEN sum(n) % 3 = 1 THEN 'accelerating' ELSE 'decelerating' END AS trend
  FROM kw_ranked WHERE rank BETWEEN 2 AND 10 GROUP BY token)"""
