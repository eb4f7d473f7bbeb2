"""Queries on keywords, counts, trends, listings and merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom import storage
from trendloom.functions import text
from trendloom.operators import corpus, counts, signals, trends, velocity
from trendloom.plans import views as v
from trendloom.plans.define import Book
from trendloom.sources import merge, papers

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles


def paper_keywords(spark, d, n=10):
    return text.keywords(v.papers(spark, d), n)


@query(f"WITH {v.PAPERS} SELECT arxiv_id, list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[a-zA-Z]{{3,}}'), lambda w: w NOT IN ({v._quoted(v.STOPWORDS)})) AS tokens FROM papers")
def text_tokens(spark, d):
    return v.papers(spark, d).select("arxiv_id", text.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("tokens"))


@query(f"WITH {v.KEYWORDS} SELECT arxiv_id, token AS keyword, n AS frequency, rank FROM kw_ranked WHERE rank <= 10")
def text_keywords(spark, d):
    return paper_keywords(spark, d)


@query(f"WITH {v.CONCEPTS} SELECT paper_id, concept, weight, rank FROM concepts")
def text_weighted_concepts(spark, d):
    return text.weighted_concepts(v.user_documents(spark, d))


_COUNTS = f"""{v.KEYWORDS},
counts AS (
  SELECT token AS keyword, category, CAST(date_trunc('month', published_at) AS TIMESTAMP) AS window_date, count(*) AS count
  FROM kw_ranked JOIN (SELECT arxiv_id, published_at, unnest(list_distinct(categories)) AS category FROM papers) USING (arxiv_id)
  WHERE rank <= 10 GROUP BY ALL)"""


def monthly_counts(spark, d):
    return counts.keyword_counts(paper_keywords(spark, d), v.papers(spark, d))


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def keyword_counts(spark, d):
    return monthly_counts(spark, d)


@query(f"WITH {v.KEYWORDS} SELECT token AS keyword, 'all' AS category, TIMESTAMP '2024-06-01' AS window_date, count(*) AS count FROM kw_ranked WHERE rank <= 10 GROUP BY token")
def keyword_counts_undated(spark, d):
    return counts.keyword_counts(paper_keywords(spark, d), window_date=dt.date(2024, 6, 1))


_TOP = """top AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, keyword, window_date) AS rank
  FROM (SELECT keyword, category, window_date, CAST(sum(count) AS BIGINT) AS total FROM kc
        WHERE window_date BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31' GROUP BY ALL))"""
_SLOPE = """slopes AS (
  SELECT keyword, category, coalesce(regr_slope(CAST(total AS DOUBLE), CAST(x AS DOUBLE)), 0) AS slope, count(*) AS n_days
  FROM (SELECT *, row_number() OVER (PARTITION BY keyword, category ORDER BY window_date) - 1 AS x
        FROM (SELECT keyword, category, window_date, sum(count) AS total FROM kc WHERE window_date BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY ALL))
  GROUP BY keyword, category)"""
_SCORES = f"""{v.DENSE}, {_TOP}, {_SLOPE},
scores AS (
  SELECT keyword, category, slope AS score, CASE WHEN slope > 0.5 THEN 'rising' WHEN slope < -0.5 THEN 'falling' ELSE 'stable' END AS trend_direction,
         TIMESTAMP '2024-01-31' AS window_start, TIMESTAMP '2024-02-01' AS window_end
  FROM slopes JOIN (SELECT DISTINCT keyword, category FROM top WHERE rank <= 20) USING (keyword, category))"""


@query(f"WITH {v.DENSE}, {_TOP} SELECT * FROM top WHERE rank <= 20")
def trending(spark, d):
    return trends.trending(v.dense_counts(spark, d), as_of=v.EVENTS_AS_OF)


@query(f"WITH {v.DENSE}, {_SLOPE} SELECT keyword, category, round(slope, 6) AS slope, n_days FROM slopes")
def keyword_slope(spark, d):
    return trends.keyword_slope(v.dense_counts(spark, d), as_of=v.EVENTS_AS_OF).withColumn("slope", F.round("slope", 6))


def scored(spark, d):
    return trends.score(v.dense_counts(spark, d), v.EVENTS_AS_OF, v.EVENTS_AS_OF)


@query(f"WITH {_SCORES} SELECT * REPLACE (round(score, 6) AS score) FROM scores")
def trend_scores(spark, d):
    return scored(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH {_SCORES}, series AS (
  SELECT keyword, CAST(sum(c) AS BIGINT) AS total_count, list(c ORDER BY window_date) AS daily_counts
  FROM (SELECT keyword, window_date, CAST(sum(count) AS BIGINT) AS c FROM kc WHERE category = 'u1' GROUP BY ALL) GROUP BY keyword)
SELECT keyword, category, round(score, 6) AS score, trend_direction, window_start, total_count, daily_counts
FROM scores JOIN series USING (keyword) WHERE category = 'u1' ORDER BY score DESC, keyword LIMIT 10""")
def trend_summary(spark, d):
    return trends.summary(scored(spark, d), v.dense_counts(spark, d), "u1").withColumn("score", F.round("score", 6))


@query(f"""WITH {v.KEYWORDS}, words AS (SELECT token AS keyword, min(arxiv_id || '/' || printf('%02d', rank)) AS pos FROM kw_ranked WHERE rank <= 10 GROUP BY token),
g AS (SELECT CASE WHEN length(keyword) >= 4 THEN '4:' || substr(keyword, 1, 4) ELSE 's:' || keyword END AS g, list(keyword ORDER BY pos, keyword) AS m FROM words GROUP BY 1)
SELECT m[1] AS label, m AS members FROM g""")
def prefix_clusters(spark, d):
    kw = paper_keywords(spark, d).groupBy("keyword").agg(F.min(F.format_string("%s/%02d", "arxiv_id", "rank")).alias("pos"))
    return trends.prefix_clusters(kw.select("pos", "keyword"))


@query(f"""WITH {v.KEYWORDS}, words AS (SELECT token AS keyword, min(arxiv_id || '/' || printf('%02d', rank)) AS pos FROM kw_ranked WHERE rank <= 10 GROUP BY token)
SELECT CASE WHEN length(keyword) >= 4 THEN first_value(keyword) OVER (PARTITION BY length(keyword) >= 4, substr(keyword, 1, 4) ORDER BY pos, keyword) ELSE keyword END AS label, pos, keyword FROM words""")
def prefix_members(spark, d):
    kw = paper_keywords(spark, d).groupBy("keyword").agg(F.min(F.format_string("%s/%02d", "arxiv_id", "rank")).alias("pos"))
    return trends.prefix_members(kw.select("pos", "keyword"))


_CONCEPT_NAMES = """names AS (
  SELECT DISTINCT a.keyword || ' of ' || b.keyword AS concept_name
  FROM (SELECT DISTINCT event_type AS keyword FROM events) a, (SELECT DISTINCT event_type AS keyword FROM events) b)"""
_TOKENS = f"""words AS (SELECT concept_name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(concept_name), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({v._quoted(velocity.CONCEPT_STOPWORDS)})))) AS token FROM names)"""
_WEEKS = """weeks AS (
  SELECT concept_name, CAST(date_trunc('week', window_date) AS TIMESTAMP) AS week, CAST(sum(count) AS BIGINT) AS weekly_count
  FROM words JOIN kc ON token = keyword GROUP BY ALL)"""


def concept_names(spark, d):
    kinds = v.table(spark, d, "events").select("event_type").distinct()  # a handful of types
    return kinds.crossJoin(kinds.withColumnRenamed("event_type", "b")).select(F.format_string("%s of %s", "event_type", "b").alias("concept_name"))


@query(f"WITH {_CONCEPT_NAMES}, {_TOKENS} SELECT * FROM words")
def concept_tokens(spark, d):
    return velocity.concept_tokens(concept_names(spark, d))


@query(f"WITH {v.DENSE}, {_CONCEPT_NAMES}, {_TOKENS}, {_WEEKS} SELECT * FROM weeks")
def weekly_counts(spark, d):
    return velocity.weekly_counts(velocity.concept_tokens(concept_names(spark, d)), v.dense_counts(spark, d))


@query(f"""WITH {v.DENSE}, {_CONCEPT_NAMES}, {_TOKENS}, {_WEEKS},
a AS (SELECT *, weekly_count - lag(weekly_count) OVER w AS v FROM weeks WINDOW w AS (PARTITION BY concept_name ORDER BY week)),
b AS (SELECT *, lag(v) OVER w AS u, row_number() OVER (PARTITION BY concept_name ORDER BY week DESC) AS rn, count(*) OVER (PARTITION BY concept_name) AS k FROM a WINDOW w AS (PARTITION BY concept_name ORDER BY week))
SELECT concept_name, coalesce(CAST(v AS DOUBLE), 0) AS velocity, coalesce(CAST(v - u AS DOUBLE), 0) AS acceleration,
       CASE WHEN v > 0 AND u > 0 THEN 'accelerating' WHEN v < 0 AND u < 0 THEN 'decelerating' ELSE 'stable' END AS trend,
       CAST(coalesce(k, 0) AS INTEGER) AS weeks_of_data, TIMESTAMP '2024-01-31' AS computed_at
FROM names LEFT JOIN (SELECT * FROM b WHERE rn = 1) USING (concept_name)""")
def concept_velocity(spark, d):
    return velocity.compute(concept_names(spark, d), v.dense_counts(spark, d), v.EVENTS_AS_OF)


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, title, published_at FROM papers WHERE list_contains(categories, 'en') AND published_at >= TIMESTAMP '2024-07-03' ORDER BY published_at DESC, arxiv_id LIMIT 20")
def list_papers(spark, d):
    return corpus.list_papers(v.papers(spark, d), "en", 90, 20, v.PAPERS_AS_OF).select("id", "arxiv_id", "title", "published_at")


@query(f"WITH {v.PAPERS} SELECT category, count(*) AS n FROM (SELECT unnest(list_distinct(categories)) AS category FROM papers WHERE published_at >= TIMESTAMP '2024-07-03') GROUP BY category")
def count_papers(spark, d):
    return corpus.count_papers(v.papers(spark, d), None, 90, v.PAPERS_AS_OF)


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, title, abstract, published_at FROM papers WHERE arxiv_id = '2401.0000042'")
def get_paper(spark, d):
    return corpus.get_paper(v.papers(spark, d), "2401.0000042").select("id", "arxiv_id", "title", "abstract", "published_at")


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id FROM papers WHERE graph_processed_at IS NULL")
def unprocessed_papers(spark, d):
    return corpus.unprocessed(v.papers(spark, d), "graph_processed_at").select("id", "arxiv_id")


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, published_at FROM papers WHERE published_at >= TIMESTAMP '2023-01-01' AND published_at < TIMESTAMP '2023-07-01'")
def published_between(spark, d):
    return corpus.published_between(v.papers(spark, d), dt.datetime(2023, 1, 1), dt.datetime(2023, 7, 1)).select("id", "arxiv_id", "published_at")


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, published_at FROM papers WHERE published_at >= TIMESTAMP '2023-01-01' AND published_at < TIMESTAMP '2023-07-01'")
def published_between_by_month(spark, d):
    """The same from papers laid out by month, of which only six months are read."""
    return corpus.published_between(_by_month(spark, d), dt.datetime(2023, 1, 1), dt.datetime(2023, 7, 1)).select("id", "arxiv_id", "published_at")


def _by_month(spark, d):
    path = storage.fresh_path(spark, "papers-by-month")
    papers.write_by_month(v.papers(spark, d), path)
    return spark.read.schema(papers.by_month(v.papers(spark, d)).schema).parquet(path)


_WINDOWS = f"""WITH {v.PAPERS}, w AS (
  SELECT m AS month, greatest(m, TIMESTAMP '2022-03-10') AS window_start, least(m + INTERVAL 1 MONTH, TIMESTAMP '2022-11-20') AS window_end
  FROM (SELECT unnest(generate_series(TIMESTAMP '2022-03-01', TIMESTAMP '2022-11-20', INTERVAL 1 MONTH)) AS m))"""


@query(f"{_WINDOWS} SELECT month, count(*) AS n FROM papers JOIN w ON date_trunc('month', published_at) = month AND published_at BETWEEN window_start AND window_end GROUP BY ALL")
def month_windows_by_month(spark, d):
    """Counts from papers laid out by month: the windows name the folders that are read."""
    return corpus.papers_by_month(_by_month(spark, d), corpus.month_windows(spark, dt.datetime(2022, 3, 10), dt.datetime(2022, 11, 20)))


@query(f"""WITH {v.PAPERS}, w AS (
  SELECT m AS month, greatest(m, TIMESTAMP '2022-03-10') AS window_start, least(m + INTERVAL 1 MONTH, TIMESTAMP '2022-11-20') AS window_end
  FROM (SELECT unnest(generate_series(TIMESTAMP '2022-03-01', TIMESTAMP '2022-11-20', INTERVAL 1 MONTH)) AS m))
SELECT month, window_start, window_end, count(*) AS n FROM papers JOIN w ON date_trunc('month', published_at) = month AND published_at BETWEEN window_start AND window_end GROUP BY ALL""")
def month_windows(spark, d):
    windows = corpus.month_windows(spark, dt.datetime(2022, 3, 10), dt.datetime(2022, 11, 20))
    return corpus.papers_by_month(v.papers(spark, d), windows).join(windows, "month").select("month", "window_start", "window_end", "n")


def _halves(spark, d):
    """Papers known before, and a batch that overlaps them and repeats itself."""
    p = v.papers(spark, d).select("id", "arxiv_id", "title")
    batch = p.where("id % 3 <> 0")
    return p.where("id % 2 = 0"), batch.union(batch.where("id % 5 = 0"))


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, title FROM papers WHERE id % 2 = 0 OR id % 3 <> 0")
def insert_ignore(spark, d):
    return merge.insert_ignore(*_halves(spark, d), ["arxiv_id"])


@query(f"""WITH {v.PAPERS} SELECT count(*) FILTER (id % 2 <> 0 AND id % 3 <> 0) AS new,
  count(*) FILTER (id % 3 <> 0) + count(*) FILTER (id % 3 <> 0 AND id % 5 = 0) - count(*) FILTER (id % 2 <> 0 AND id % 3 <> 0) AS skipped FROM papers""")
def insert_counts(spark, d):
    return merge.insert_counts(*_halves(spark, d), ["arxiv_id"])


@query(f"WITH {v.CITATIONS} SELECT * FROM citations")
def insert_citations(spark, d):
    c = v.citations(spark, d)
    return merge.insert_ignore(c.where("citation_type = 'citation'"), c, ["source_arxiv_id", "cited_paper_id", "citation_type"])


@query(f"WITH {v.DENSE} SELECT keyword, category, window_date, CASE WHEN window_date >= TIMESTAMP '2024-01-15' THEN 2 * count ELSE count END AS count FROM kc")
def accumulate_counts(spark, d):
    kc = v.dense_counts(spark, d)
    return merge.accumulate(kc, kc.where("window_date >= timestamp'2024-01-15'"), ["keyword", "category", "window_date"], ["count"])


@query(f"WITH {v.DENSE} SELECT keyword, category, window_date, CASE WHEN window_date >= TIMESTAMP '2024-01-15' THEN -count ELSE count END AS count FROM kc")
def replace_counts(spark, d):
    kc = v.dense_counts(spark, d)
    new = kc.where("window_date >= timestamp'2024-01-15'").withColumn("count", -F.col("count"))
    return merge.replace(kc, new, ["keyword", "category", "window_date"])


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2025-01-01' ELSE graph_processed_at END AS graph_processed_at FROM papers")
def update_columns(spark, d):
    p = v.papers(spark, d).select("id", "arxiv_id", "graph_processed_at")
    return merge.update_columns(p, p.where("id % 4 = 0").select("arxiv_id", F.expr("timestamp'2025-01-01'").alias("graph_processed_at")), ["arxiv_id"])


_KEY = ["keyword", "category", "window_date"]


@query(f"""WITH {v.DENSE} SELECT keyword, category, window_date, CASE WHEN window_date >= TIMESTAMP '2024-01-15' THEN count + 3 ELSE count END AS count FROM kc""")
def replace_repeated(spark, d):
    """A batch that repeats its keys: of four writes of a key the last one stays."""
    kc = v.dense_counts(spark, d)
    writes = kc.where("window_date >= timestamp'2024-01-15'").withColumn("written", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return merge.replace(kc, writes.withColumn("count", F.col("count") + F.col("written")), _KEY, ["written"])


@query(f"""WITH {v.PAPERS} SELECT id, arxiv_id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2025-01-03' ELSE graph_processed_at END AS graph_processed_at,
  CASE WHEN id % 4 = 0 THEN TIMESTAMP '2025-01-02' END AS cooccurrence_processed_at FROM papers""")
def update_repeated(spark, d):
    """Updates that repeat their keys act one after the other; a null leaves what the one before has set."""
    p = v.papers(spark, d).select("id", "arxiv_id", "graph_processed_at").withColumn("cooccurrence_processed_at", F.lit(None).cast("timestamp"))
    writes = p.where("id % 4 = 0").select("arxiv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("written"))
    day = F.expr("timestamp'2025-01-01' + make_interval(0, 0, 0, written - 1)")
    writes = writes.select("arxiv_id", "written", day.alias("graph_processed_at"), F.when(F.col("written") < 3, day).alias("cooccurrence_processed_at"))
    return merge.update_columns(p, writes, ["arxiv_id"], ["written"])


@query(f"""WITH {v.DENSE} SELECT keyword, category, window_date, CASE WHEN window_date >= TIMESTAMP '2024-01-25' THEN -count WHEN window_date >= TIMESTAMP '2024-01-15' THEN 2 * count ELSE count END AS count FROM kc""")
def merge_stored(spark, d):
    """Counts stored by day: the first two weeks are written, then all but these twice over, of which the last days are replaced; a merge touches its days alone."""
    kc, path, late = v.dense_counts(spark, d).withColumn("day", F.to_date("window_date")), storage.fresh_path(spark, "counts"), "window_date >= timestamp'2024-01-15'"

    def added(target, batch):
        return merge.accumulate(target, batch, [*_KEY, "day"], ["count"])

    merge.merge_into(spark, path, kc.where(f"NOT {late}"), "day", added)
    for _ in range(2):
        merge.merge_into(spark, path, kc.where(late), "day", added)
    last = kc.where("window_date >= timestamp'2024-01-25'").withColumn("count", -F.col("count"))
    merge.merge_into(spark, path, last.union(last.withColumn("count", F.col("count") - 1)), "day", lambda t, b: merge.replace(t, b, _KEY))
    return merge.read_partitions(spark, path, kc.schema, "day").drop("day")


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id, CASE WHEN id % 7 = 0 THEN TIMESTAMP '2025-01-01' ELSE graph_processed_at END AS graph_processed_at FROM papers")
def update_stored(spark, d):
    """Papers stored in hash buckets of their key; stamps reach them by the same hash."""
    path = storage.fresh_path(spark, "papers")
    p = merge.with_bucket(v.papers(spark, d).select("id", "arxiv_id", "graph_processed_at"), ["arxiv_id"], 16)
    merge.merge_into(spark, path, p, "bucket", lambda t, b: merge.insert_ignore(t, b, ["arxiv_id"]))
    stamps = p.where("id % 7 = 0").select("arxiv_id", F.expr("timestamp'2025-01-01'").alias("graph_processed_at"))
    stamps = merge.with_bucket(stamps.union(stamps), ["arxiv_id"], 16)
    merge.merge_into(spark, path, stamps, "bucket", lambda t, b: merge.update_columns(t, b, ["arxiv_id", "bucket"]), p.schema)
    return merge.read_partitions(spark, path, p.schema, "bucket").drop("bucket")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_seen(spark, d):
    orders = v.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return merge.first_seen(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH {v.PAPERS} SELECT arxiv_id, 'Title: ' || title || chr(10) || 'Abstract: ' || substr(abstract, 1, 800) AS prompt FROM papers")
def extraction_prompt(spark, d):
    return text.extraction_prompt(v.papers(spark, d))


@query(f"""WITH {v.KEYWORDS} SELECT category, keyword, total, rank FROM (
  SELECT category, token AS keyword, count(*) AS total, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, token) AS rank
  FROM kw_ranked JOIN (SELECT arxiv_id, unnest(list_distinct(categories)) AS category FROM papers) USING (arxiv_id) WHERE kw_ranked.rank <= 10 GROUP BY category, token) WHERE rank <= 5""")
def top_per_category(spark, d):
    """Keywords that most papers of a category have, five each."""
    totals = monthly_counts(spark, d).groupBy("category", "keyword").agg(F.sum("count").alias("total"))
    best = signals.top(totals, "total", 5, per="category", tie="keyword")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("total"), "keyword")))
