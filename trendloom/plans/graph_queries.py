"""Queries on the property graph, centrality, ranked signals and similarity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trendloom import storage
from trendloom.functions import text
from trendloom.operators import centrality, corpus, graph, signals, similarity
from trendloom.plans import views as v
from trendloom.plans.define import Book
from trendloom.sources import papers as sources

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles


def paper_keywords(spark, d):
    """The first 13 keywords of all papers, counted once and written down, since most queries here read them several times."""
    return storage.materialize(text.keywords(v.papers(spark, d), 13), "keywords")


def extractions(spark, d):
    """A paper's first eight keywords as concepts and the next five as methods."""
    kw = paper_keywords(spark, d)
    lists = kw.groupBy("arxiv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    return lists.select("arxiv_id", F.slice(F.col("k.keyword"), 1, 8).alias("concepts"), F.expr("slice(k.keyword, 9, 5)").alias("methods"))


_GRAPH = f"""{v.KEYWORDS}, {v.AUTHORS}, {v.CITATIONS},
mentions AS (SELECT DISTINCT arxiv_id, token AS concept_name FROM kw_ranked WHERE rank <= 8),
methods AS (SELECT DISTINCT arxiv_id, token AS name FROM kw_ranked WHERE rank BETWEEN 9 AND 13),
cited AS (SELECT * FROM citations WHERE citation_type = 'citation'),
clean AS (SELECT arxiv_id, trim(substr(regexp_replace(translate(coalesce(title, ''), '''\\$', ''), '[\\r\\n]', ' ', 'g'), 1, 200), '{text.WHITE}') AS name, year(published_at) AS year FROM papers),
vertices AS (
  SELECT 'Paper' AS label, key, max(name) AS name, CAST(max(year) AS INTEGER) AS year
  FROM (SELECT arxiv_id AS key, name, year FROM clean UNION ALL SELECT cited_paper_id, NULL, NULL FROM cited) GROUP BY key
  UNION ALL SELECT DISTINCT 'Author', author_id, author_name, CAST(NULL AS INTEGER) FROM authors
  UNION ALL SELECT 'Concept', name, name, CAST(NULL AS INTEGER) FROM (SELECT concept_name AS name FROM mentions UNION SELECT name FROM methods)),
edges AS (
  SELECT DISTINCT paper_id AS src, 'BY' AS rel, author_id AS dst FROM authors
  UNION ALL SELECT arxiv_id, 'MENTIONS', concept_name FROM mentions
  UNION ALL SELECT arxiv_id, 'USES_METHOD', name FROM methods
  UNION ALL SELECT DISTINCT source_arxiv_id, 'CITES', cited_paper_id FROM cited),
pairs AS (SELECT DISTINCT a.concept_name AS src, b.concept_name AS dst FROM mentions a JOIN mentions b USING (arxiv_id) WHERE a.concept_name <> b.concept_name)"""


def _vertices(spark, d, found=None):
    return graph.vertices(v.papers(spark, d), found or extractions(spark, d), v.authors(spark, d), v.citations(spark, d))


def _edges(spark, d, found=None):
    return graph.edges(found or extractions(spark, d), v.authors(spark, d), v.citations(spark, d))


@query(f"WITH {v.PAPERS} SELECT arxiv_id, trim(substr(regexp_replace(translate(title, '''\\$', ''), '[\\r\\n]', ' ', 'g'), 1, 200), '{text.WHITE}') AS label FROM papers")
def graph_sanitize(spark, d):
    return v.papers(spark, d).select("arxiv_id", graph.sanitize(F.col("title")).alias("label"))


@query(f"WITH {_GRAPH} SELECT label, key, name, coalesce(year, 0) AS year FROM vertices")
def graph_vertices(spark, d):
    return _vertices(spark, d).withColumn("year", F.coalesce("year", F.lit(0)))


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {_GRAPH} SELECT src, 'CO_OCCURS_WITH' AS rel, dst FROM pairs")
def graph_cooccurrence(spark, d):
    return graph.cooccurrence(graph.mentions(extractions(spark, d)))


@query(f"""WITH {_GRAPH} SELECT DISTINCT a.concept_name AS src, 'CO_OCCURS_WITH' AS rel, b.concept_name AS dst
FROM mentions a JOIN mentions b USING (arxiv_id) JOIN papers USING (arxiv_id) WHERE a.concept_name <> b.concept_name AND graph_processed_at IS NULL""")
def graph_cooccurrence_pending(spark, d):
    pending = corpus.unprocessed(v.papers(spark, d), "graph_processed_at")
    return graph.cooccurrence(graph.mentions(extractions(spark, d)), pending)


def _steps(spark, d):
    """Mentions, and the papers of two runs: first those that have been processed, of which two in three are known; then all."""
    p = v.papers(spark, d).select("id", "arxiv_id", "graph_processed_at").withColumn("cooccurrence_processed_at", F.lit(None).cast("timestamp"))
    return graph.mentions(extractions(spark, d)), p.where("graph_processed_at IS NOT NULL"), p.where("graph_processed_at IS NULL")


RUNS = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)


@query(f"WITH {_GRAPH} SELECT src, 'CO_OCCURS_WITH' AS rel, dst FROM pairs")
def graph_cooccurrence_twice(spark, d):
    """Edges of two runs, of which the second sees all papers and makes pairs of the new ones only: those of the full build."""
    found, first, later = _steps(spark, d)
    none = spark.createDataFrame([], "src string, rel string, dst string")
    known, stamped = graph.add_cooccurrence(none, found, first, RUNS[0])
    known = storage.materialize(known, "known-edges")
    return graph.add_cooccurrence(known, found, stamped.union(later), RUNS[1])[0]


def _stored_steps(spark, d):
    found, first, later = _steps(spark, d)
    path = storage.fresh_path(spark, "edges")
    stamped = graph.extend_cooccurrence(spark, path, found, first, RUNS[0], 32)
    return path, graph.extend_cooccurrence(spark, path, found, stamped.union(later), RUNS[1], 32)


@query(f"WITH {_GRAPH} SELECT src, 'CO_OCCURS_WITH' AS rel, dst FROM pairs")
def graph_cooccurrence_stored(spark, d):
    """The same by the stored table, whose buckets two runs append to."""
    return graph.stored_cooccurrence(spark, _stored_steps(spark, d)[0])


@query(f"WITH {v.PAPERS} SELECT arxiv_id, CASE WHEN graph_processed_at IS NULL THEN TIMESTAMP '2025-01-02' ELSE TIMESTAMP '2025-01-01' END AS cooccurrence_processed_at FROM papers")
def graph_cooccurrence_stamps(spark, d):
    """The run that took each paper in."""
    return _stored_steps(spark, d)[1].select("arxiv_id", "cooccurrence_processed_at")


@query(f"""WITH {_GRAPH} SELECT (SELECT count(DISTINCT src) FROM pairs) AS graph_node_count, (SELECT count(*) FROM pairs) AS graph_edge_count""")
def graph_concept_subgraph(spark, d):
    return graph.subgraph_size(graph_concept_pairs(spark, d))


@query(f"WITH {_GRAPH} SELECT src, dst FROM pairs")
def graph_concept_pairs(spark, d):
    """The subgraph itself, whose size is graph_concept_subgraph."""
    found = extractions(spark, d)
    links = _edges(spark, d, found).union(graph.cooccurrence(graph.mentions(found)))
    return graph.concept_subgraph(_vertices(spark, d, found), links)


@query(f"""WITH {_GRAPH},
own AS (SELECT arxiv_id, count(*) AS c FROM kw_ranked WHERE rank <= 13 GROUP BY arxiv_id),
b AS (SELECT paper_id AS arxiv_id, count(*) AS n FROM authors GROUP BY 1),
x AS (SELECT source_arxiv_id AS arxiv_id, count(*) AS n FROM cited GROUP BY 1)
SELECT own.arxiv_id, c AS concepts_issued, c + coalesce(b.n, 0) + coalesce(x.n, 0) AS edges_issued FROM own LEFT JOIN b USING (arxiv_id) LEFT JOIN x USING (arxiv_id)""")
def graph_build_metrics(spark, d):
    return graph.build_metrics(extractions(spark, d), v.authors(spark, d), v.citations(spark, d))


@query(f"WITH {_GRAPH} SELECT label AS kind, count(*) AS n FROM vertices GROUP BY 1 UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1")
def graph_counts(spark, d):
    found = extractions(spark, d)
    return graph.counts(_vertices(spark, d, found), _edges(spark, d, found))


@query(f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM papers) AS total_papers, (SELECT count(graph_processed_at) FROM papers) AS processed_papers,
  (SELECT min(published_at) FROM papers) AS first_published, (SELECT max(published_at) FROM papers) AS last_published,
  (SELECT count(*) FROM vertices WHERE label = 'Concept') AS concepts, (SELECT count(*) FROM edges) AS edges, (SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders) AS last_run""")
def graph_stats(spark, d):
    runs = v.table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("generated_at"))
    found = extractions(spark, d)
    return corpus.graph_stats(v.papers(spark, d), _vertices(spark, d, found), _edges(spark, d, found), runs)


def _betweenness_sql(pivots: int, depth: int) -> str:
    """Levels of shortest paths one CTE after the other; the deepest must be empty on the data at hand."""
    parts = [_GRAPH, "nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM pairs)", "e AS MATERIALIZED (SELECT * FROM pairs)",
             f"pv AS MATERIALIZED (SELECT node FROM nodes ORDER BY md5(node || '42'), node LIMIT {pivots})",
             "l0 AS MATERIALIZED (SELECT node AS root, node, 1.0::DOUBLE AS sigma FROM pv)"]
    for k in range(1, depth):
        seen = " UNION ALL ".join(f"SELECT root, node FROM l{j}" for j in range(k))
        parts.append(f"l{k} AS MATERIALIZED (SELECT root, dst AS node, sum(sigma) AS sigma FROM l{k - 1} JOIN e ON node = src WHERE (root, dst) NOT IN ({seen}) GROUP BY root, dst)")
    parts.append(f"d{depth - 1} AS (SELECT root, node, sigma, 0.0::DOUBLE AS dep FROM l{depth - 1})")
    for k in range(depth - 2, -1, -1):
        parts.append(f"""d{k} AS MATERIALIZED (SELECT l.root, l.node, l.sigma, coalesce(sum(l.sigma / w.sigma * (1 + w.dep)), 0) AS dep
  FROM l{k} l LEFT JOIN (SELECT e.src, d.* FROM e JOIN d{k + 1} d ON e.dst = d.node) w ON w.root = l.root AND w.src = l.node GROUP BY l.root, l.node, l.sigma)""")
    total = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(depth))
    return f"""WITH {", ".join(parts)}, dep AS (SELECT node, sum(dep) AS dep FROM ({total}) WHERE node <> root GROUP BY node),
c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM pv) AS k)
SELECT nodes.node AS concept_name, round(coalesce(dep, 0) / ((k - CASE WHEN pv.node IS NULL THEN 0 ELSE 1 END) * (n - 2)), 9) AS centrality_score,
       n AS graph_node_count, (SELECT count(*) FROM pairs) AS graph_edge_count
FROM nodes CROSS JOIN c LEFT JOIN dep ON dep.node = nodes.node LEFT JOIN pv ON pv.node = nodes.node"""


@query(_betweenness_sql(6, 9))
def betweenness(spark, d):
    """Every concept's centrality from six pivots."""
    pairs = graph.cooccurrence(graph.mentions(extractions(spark, d))).select("src", "dst")
    return centrality.betweenness(pairs, k_samples=6, top_n=None).withColumn("centrality_score", F.round("centrality_score", 9))


@query(_betweenness_sql(200, 9))
def betweenness_default(spark, d):
    """Every concept's centrality from the operator's default number of pivots."""
    pairs = graph.cooccurrence(graph.mentions(extractions(spark, d))).select("src", "dst")
    return centrality.betweenness(pairs, top_n=None).withColumn("centrality_score", F.round("centrality_score", 9))


def bridge(spark, d, kw=None):
    kw = (kw or paper_keywords(spark, d)).where("rank <= 8")
    return kw.groupBy(F.col("keyword").alias("concept_name")).agg(F.count("*").cast("double").alias("centrality_score"))


def velocities(spark, d, kw=None):
    kw = (kw or paper_keywords(spark, d)).where("rank BETWEEN 2 AND 10").groupBy(F.col("keyword").alias("concept_name"))
    got = kw.agg(F.sum("frequency").alias("s"), F.count("*").alias("c"), (F.max("frequency") - F.min("frequency")).cast("double").alias("acceleration"))
    trend = F.when(F.col("s") % 3 == 0, "stable").when(F.col("s") % 3 == 1, "accelerating").otherwise("decelerating")
    return got.select("concept_name", (F.col("s") - 3 * F.col("c")).cast("double").alias("velocity"), "acceleration", trend.alias("trend"))


def _norm(c: str, rows: str) -> str:
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END"


_SIGNALS = f"""{v.BRIDGE},
combined AS (SELECT b.concept_name, centrality_score, coalesce(velocity, 0) AS velocity, coalesce(acceleration, 0) AS acceleration, coalesce(trend, 'stable') AS trend FROM bridge b LEFT JOIN velocity USING (concept_name)),
signals AS (SELECT *, 0.6 * {_norm("centrality_score", "combined")} + 0.4 * {_norm("velocity", "combined")} AS composite_score FROM combined)"""


def _round(df):
    return df.withColumn("composite_score", F.round("composite_score", 6))


def inputs(spark, d):
    """The ranking's two inputs, from keywords counted once."""
    kw = paper_keywords(spark, d)
    return bridge(spark, d, kw), velocities(spark, d, kw)


def all_signals(spark, d):
    return signals.score(*inputs(spark, d))


@query(f"WITH {_SIGNALS} SELECT * FROM combined")
def signals_combine(spark, d):
    return signals.combine(*inputs(spark, d))


@query(f"WITH {v.BRIDGE} SELECT concept_name, centrality_score, round({_norm('centrality_score', 'bridge')}, 9) AS norm_centrality_score FROM bridge")
def signals_minmax(spark, d):
    return signals.minmax(bridge(spark, d), "centrality_score").withColumn("norm_centrality_score", F.round("norm_centrality_score", 9))


@query(f"WITH {_SIGNALS} SELECT * REPLACE (round(composite_score, 6) AS composite_score) FROM (SELECT * FROM signals ORDER BY composite_score DESC, concept_name LIMIT 200)")
def signals_rank(spark, d):
    return _round(signals.rank(*inputs(spark, d), 200))


@query(f"WITH {_SIGNALS} SELECT * REPLACE (round(composite_score, 6) AS composite_score) FROM (SELECT * FROM signals ORDER BY composite_score DESC, concept_name LIMIT 25 OFFSET 50)")
def signals_page(spark, d):
    return _round(signals.page(*inputs(spark, d), 25, 50))


@query(f"""WITH {v.BRIDGE}, f AS (SELECT * FROM bridge JOIN velocity USING (concept_name) WHERE trend = 'accelerating')
SELECT * REPLACE (round(composite_score, 6) AS composite_score) FROM (
  SELECT concept_name, centrality_score, velocity, acceleration, trend, round(0.6 * {_norm("centrality_score", "f")} + 0.4 * {_norm("velocity", "f")}, 6) AS composite_score FROM f)
ORDER BY composite_score DESC, concept_name LIMIT 20""")
def signals_query_graph(spark, d):
    return signals.query_graph(*inputs(spark, d), 20, "accelerating")


@query(f"WITH {_SIGNALS} SELECT concept_name, trend, velocity FROM signals WHERE trend = 'decelerating'")
def signals_filter_trend(spark, d):
    return signals.filter_trend(all_signals(spark, d), "decelerating").select("concept_name", "trend", "velocity")


def papers_by_month(spark, d):
    """The papers as a table laid out by month of publication."""
    path = storage.fresh_path(spark, "papers-by-month")
    sources.write_by_month(v.papers(spark, d), path)
    return spark.read.schema(sources.by_month(v.papers(spark, d)).schema).parquet(path)


_MENTIONED = f"""{_GRAPH}, m AS (
  SELECT concept_name, count(*) AS mentions FROM mentions JOIN papers USING (arxiv_id) WHERE published_at >= TIMESTAMP '2022-01-01' AND published_at < TIMESTAMP '2024-01-01' GROUP BY 1)"""


@query(f"WITH {_MENTIONED} SELECT * FROM m")
def mention_counts(spark, d):
    return signals.mention_counts(v.papers(spark, d), graph.mentions(extractions(spark, d)), dt.datetime(2022, 1, 1), dt.datetime(2024, 1, 1))


@query(f"WITH {_MENTIONED} SELECT * FROM m")
def mention_counts_by_month(spark, d):
    """The same from tables laid out by month, of which only the range's months are read."""
    by_month = papers_by_month(spark, d)
    path = storage.fresh_path(spark, "mentions-by-month")
    mentions = graph.mentions(extractions(spark, d)).join(by_month.select("arxiv_id", "month"), "arxiv_id")
    mentions.hint("rebalance", "month").write.partitionBy("month").parquet(path)
    stored = spark.read.schema(mentions.schema).parquet(path)
    return signals.mention_counts(by_month, stored, dt.datetime(2022, 1, 1), dt.datetime(2024, 1, 1))


@query(f"""WITH {_MENTIONED},
vel AS (SELECT token AS concept_name, CAST(sum(n) - 3 * count(*) AS DOUBLE) AS velocity, CAST(max(n) - min(n) AS DOUBLE) AS acceleration,
  CASE WHEN sum(n) % 3 = 0 THEN 'stable' WHEN sum(n) % 3 = 1 THEN 'accelerating' ELSE 'decelerating' END AS trend FROM kw_ranked WHERE rank BETWEEN 2 AND 10 GROUP BY token),
t AS (SELECT concept_name, mentions, CAST(mentions AS DOUBLE) AS centrality_score FROM m ORDER BY mentions DESC, concept_name LIMIT 60),
j AS (SELECT t.*, coalesce(velocity, 0) AS velocity, coalesce(acceleration, 0) AS acceleration, coalesce(trend, 'stable') AS trend FROM t LEFT JOIN vel USING (concept_name))
SELECT * REPLACE (round(composite_score, 6) AS composite_score) FROM (
  SELECT *, 0.6 * {_norm("centrality_score", "j")} + 0.4 * {_norm("velocity", "j")} AS composite_score FROM j ORDER BY composite_score DESC, concept_name LIMIT 20)""")
def signals_date_range(spark, d):
    return _round(signals.for_date_range(v.papers(spark, d), graph.mentions(extractions(spark, d)), velocities(spark, d), dt.datetime(2022, 1, 1), dt.datetime(2024, 1, 1), 20))


@query(f"""WITH {_SIGNALS}, spread AS (
  SELECT concept_name, composite_score FROM signals UNION ALL SELECT upper(concept_name), composite_score / 2 FROM signals),
best AS (SELECT lower(concept_name) AS concept_key, arg_max(concept_name, composite_score * 1e6 + CASE WHEN concept_name = lower(concept_name) THEN 1 ELSE 0 END) AS concept_name, max(composite_score) AS composite_score FROM spread GROUP BY 1)
SELECT concept_key, concept_name, round(composite_score, 6) AS composite_score, upper(concept_key[1]) || substr(concept_key, 2) AS display_name, round(greatest(max(composite_score) OVER (), 1), 6) AS max_score FROM best""")
def signals_dedup_case(spark, d):
    s = all_signals(spark, d).select("concept_name", "composite_score")
    both = s.union(s.select(F.upper("concept_name"), F.col("composite_score") / 2))
    return _round(signals.dedup_case(both)).withColumn("max_score", F.round("max_score", 6))


@query(f"WITH {_SIGNALS} SELECT t AS trend, count(concept_name) AS n FROM (VALUES ('accelerating'), ('decelerating'), ('stable')) x(t) LEFT JOIN signals ON trend = t GROUP BY t")
def signals_trend_counts(spark, d):
    return signals.trend_counts(all_signals(spark, d))


@query(f"WITH {_SIGNALS} SELECT concept_name, trend, velocity FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY velocity DESC, concept_name) AS n FROM signals) WHERE n <= 10")
def signals_top_per_trend(spark, d):
    return signals.top(all_signals(spark, d), "velocity", 10, per="trend").select("concept_name", "trend", "velocity")


@query(f"WITH {_SIGNALS} SELECT concept_name, velocity FROM signals ORDER BY velocity, concept_name LIMIT 20")
def signals_sort_by(spark, d):
    return signals.sort_by(all_signals(spark, d), "velocity", True, 20).select("concept_name", "velocity")


_PHRASES = f"""{_SIGNALS}, named AS (
  SELECT concept_name || ' ' || substr(concept_name, 1, 5) || ' model' AS concept_name, composite_score FROM signals),
tok AS (SELECT concept_name, composite_score, unnest(regexp_split_to_array(lower(concept_name), '\\s+')) AS token FROM named)"""


def phrases(spark, d):
    s = all_signals(spark, d)
    return s.select(F.format_string("%s %s model", F.col("concept_name"), F.substring("concept_name", 1, 5)).alias("concept_name"), "composite_score")


@query(f"""WITH {_PHRASES}, best AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, concept_name) AS r FROM named ORDER BY r LIMIT 100),
t AS (SELECT best.concept_name, r, token FROM best JOIN tok USING (concept_name) WHERE length(token) > 3)
SELECT a.concept_name AS source, b.concept_name AS target, count(*) AS weight
FROM t a JOIN (SELECT DISTINCT * FROM t) b ON a.token = b.token AND a.r < b.r GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 200""")
def token_overlap_edges(spark, d):
    return graph.token_overlap_edges(phrases(spark, d))


@query(f"""WITH {_PHRASES}, t AS (SELECT DISTINCT concept_name, token FROM tok WHERE length(token) > 3),
s AS (SELECT a.concept_name, b.concept_name AS related, count(*) AS shared FROM t a JOIN t b USING (token) WHERE a.concept_name <> b.concept_name GROUP BY ALL)
SELECT concept_name, related, shared FROM (SELECT *, row_number() OVER (PARTITION BY concept_name ORDER BY shared DESC, related) AS n FROM s) WHERE n <= 8""")
def related_concepts(spark, d):
    """Of whole names, with the token that all of them share."""
    return graph.related_concepts(phrases(spark, d).select("concept_name"))


_NEAREST = f"""{v.PAPERS}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id AS paper_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM q, embeddings e),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM near WHERE score >= 0.3)"""


def queries_of(emb):
    """The search's query set: every row whose id is divisible by 50."""
    return emb.where("paper_id % 50 = 0").select(F.col("paper_id").alias("query_id"), "embedding")


@query(f"WITH {_NEAREST} SELECT query_id, paper_id, arxiv_id, title, substr(abstract, 1, 300) AS abstract_snippet, round(score, 6) AS score, published_at, rank FROM hits JOIN papers ON id = paper_id WHERE rank <= 5")
def similarity_search(spark, d):
    emb = v.embeddings(spark, d)
    return similarity.search(emb, v.papers(spark, d), queries_of(emb), 5, 0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH {_NEAREST} SELECT query_id, string_agg('[' || i || '] ' || title || ' (' || strftime(published_at, '%Y-%m-%d') || ') — ' || substr(abstract, 1, 300), chr(10) ORDER BY i) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS i FROM hits JOIN papers ON id = paper_id WHERE rank <= 5) GROUP BY query_id""")
def similarity_context(spark, d):
    emb = v.embeddings(spark, d)
    return text.context_block(similarity.search(emb, v.papers(spark, d), queries_of(emb), 5, 0.3))


_DIRECTIONS = f"""{v.PAPERS}, {v.TOPICS}, q AS (SELECT query_id, topic, direction, embedding FROM directions),
near AS (SELECT query_id, vec_id AS paper_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM q, embeddings e WHERE q.embedding IS NOT NULL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM near WHERE score >= 0.35),
blocks AS (SELECT query_id, string_agg('[' || i || '] ' || title || ' (' || strftime(published_at, '%Y-%m-%d') || ') — ' || substr(abstract, 1, 300), chr(10) ORDER BY i) AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS i FROM hits JOIN papers ON id = paper_id WHERE rank <= 5) GROUP BY query_id)"""


def stored_vectors(spark, d):
    """Stands for a caller's embedding of a direction: the stored vector of its row; every eighth has none."""
    emb = v.embeddings(spark, d)
    return emb.where("paper_id % 50 = 0").select(F.col("paper_id").alias("query_id"), F.when(F.col("paper_id") % 400 != 0, F.col("embedding")).alias("embedding"))


@query(f"WITH {_DIRECTIONS} SELECT query_id, topic || ': ' || direction AS query, coalesce(block, '') AS block FROM q LEFT JOIN blocks USING (query_id)")
def similarity_grounding(spark, d):
    """Contexts of directions. The threshold is 0.35, since the table's unrelated vectors hardly pass the operator's 0.6."""
    return similarity.ground(v.directions(spark, d), stored_vectors(spark, d), v.embeddings(spark, d), v.papers(spark, d), 5, 0.35)


@query(f"""WITH {_DIRECTIONS} SELECT query_id, 'You are a research trend analyst. Use the numbered sources below to support your analysis. Cite sources as [1], [2], etc.' || chr(10) || chr(10)
  || 'Sources:' || chr(10) || coalesce(block, '') || chr(10) || chr(10) || 'Prediction to analyse:' || chr(10) || direction AS prompt FROM q LEFT JOIN blocks USING (query_id)""")
def prediction_prompt(spark, d):
    asked = v.directions(spark, d)
    return text.grounded_prompt(asked.select("query_id", F.col("direction").alias("text")), similarity_grounding(spark, d), "prediction")


@query(f"""WITH {_DIRECTIONS} SELECT query_id, 'You are a research assistant. Summarize what the literature says about the query below. Cite sources as [1], [2], etc.' || chr(10) || chr(10)
  || 'Sources:' || chr(10) || coalesce(block, '') || chr(10) || chr(10) || 'Query: ' || topic || ': ' || direction AS prompt FROM q LEFT JOIN blocks USING (query_id)""")
def summary_prompt(spark, d):
    found = similarity_grounding(spark, d)
    return text.grounded_prompt(found.select("query_id", F.col("query").alias("text")), found, "summary")


@query(f"WITH {v.PAPERS} SELECT id, arxiv_id FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def similarity_unembedded(spark, d):
    return similarity.unembedded(v.papers(spark, d), v.embeddings(spark, d)).select("id", "arxiv_id")


def stub_embedding(texts: list[str]) -> list[list[float] | None]:
    """Stands for a caller's model: three simple numbers of a text; none for texts with an x, and a failure of the whole call where one has a q and a z."""
    if any("q" in t and "z" in t for t in texts):
        raise ValueError("a text that the model can't take")
    return [None if "x" in t else [float(len(t)), float(t.count("a")), float(t.count(" "))] for t in texts]


@query(f"""WITH {v.PAPERS}, p AS (SELECT id, abstract AS t FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings))
SELECT id AS paper_id, CASE WHEN NOT contains(t, 'x') AND NOT (contains(t, 'q') AND contains(t, 'z')) THEN [CAST(length(t) AS DOUBLE), length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, ' ', ''))] ELSE [] END AS embedding FROM p""")
def similarity_embed_pending(spark, d):
    found = similarity.embed_pending(v.papers(spark, d), v.embeddings(spark, d), stub_embedding)
    return found.select("paper_id", F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"))


@query(f"""WITH {v.PAPERS}, p AS (SELECT id, abstract AS t FROM papers WHERE id NOT IN (SELECT vec_id FROM embeddings)),
c AS (SELECT contains(t, 'x') OR (contains(t, 'q') AND contains(t, 'z')) AS bad FROM p)
SELECT count(*) FILTER (NOT bad) AS embedded, count(*) FILTER (bad) AS skipped FROM c""")
def similarity_embed_counts(spark, d):
    return similarity.embed_counts(similarity.embed_pending(v.papers(spark, d), v.embeddings(spark, d), stub_embedding))


@query(f"""WITH {_SIGNALS}, best AS (SELECT * FROM signals ORDER BY composite_score DESC, concept_name LIMIT 20)
SELECT string_agg('- ' || concept_name || printf(': centrality=%.3f, velocity=%.1f, trend=', centrality_score, velocity) || trend, chr(10) ORDER BY composite_score DESC, concept_name) AS block FROM best""")
def signal_block(spark, d):
    return text.signal_block(all_signals(spark, d))
