"""The property graph of papers, authors and concepts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.text import strip
from trendloom.sources import merge
from trendloom.storage import materialize


def sanitize(text: Column) -> Column:
    """A label without quotes, backslashes and dollars, on one line, of 200 characters at most."""
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "'\\$", ""), r"[\r\n]", " ")
    return strip(F.substring(flat, 1, 200))


def _labels(extractions: DataFrame, field: str) -> DataFrame:
    return extractions.select("arxiv_id", F.explode(field).alias("_l")).select("arxiv_id", sanitize(F.col("_l")).alias("name")).where("name <> ''").distinct()


def mentions(extractions: DataFrame) -> DataFrame:
    """`arxiv_id, concept_name`, distinct."""
    return _labels(extractions, "concepts").withColumnRenamed("name", "concept_name")


def vertices(papers: DataFrame, extractions: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """`label, key, name, year`: papers with the stubs they are cited by, authors, concepts with methods; one row each."""
    known = papers.select(F.col("arxiv_id").alias("key"), sanitize(F.col("title")).alias("name"), F.year("published_at").alias("year"))
    stubs = citations.where("citation_type = 'citation'").select(F.col("cited_paper_id").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("year"))
    paper = known.unionByName(stubs).groupBy("key").agg(F.max("name").alias("name"), F.max("year").alias("year")).select(F.lit("Paper").alias("label"), "key", "name", "year")
    people = authors.groupBy(F.col("author_id").alias("key")).agg(F.min(sanitize(F.col("author_name"))).alias("name"))
    ideas = _labels(extractions, "concepts").select("name").union(_labels(extractions, "methods").select("name")).distinct()
    none = F.lit(None).cast("int").alias("year")
    return paper.unionByName(people.select(F.lit("Author").alias("label"), "key", "name", none)).unionByName(
        ideas.select(F.lit("Concept").alias("label"), F.col("name").alias("key"), "name", none))


def edges(extractions: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """`src, rel, dst` distinct: BY, MENTIONS, USES_METHOD and CITES (rows of type citation only)."""
    def rows(df: DataFrame, src: str, rel: str, dst: str) -> DataFrame:
        return df.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))

    return rows(authors, "paper_id", "BY", "author_id").union(rows(_labels(extractions, "concepts"), "arxiv_id", "MENTIONS", "name")).union(
        rows(_labels(extractions, "methods"), "arxiv_id", "USES_METHOD", "name")).union(
        rows(citations.where("citation_type = 'citation'"), "source_arxiv_id", "CITES", "cited_paper_id")).distinct()


def cooccurrence(found: DataFrame, only_papers: DataFrame | None = None) -> DataFrame:
    """`src, rel, dst`: ordered pairs of different concepts that a paper mentions, distinct.

    Pairs are made inside each paper's array, so only papers are grouped and then pairs.
    `only_papers(arxiv_id)` limits the work to papers not done before.
    """
    if only_papers is not None:
        found = found.join(only_papers.select("arxiv_id"), "arxiv_id", "left_semi")
    sets = found.groupBy("arxiv_id").agg(F.collect_set("concept_name").alias("c"))
    left = sets.select("c", F.explode("c").alias("src"))
    return left.select("src", F.explode("c").alias("dst")).where("src <> dst").distinct().select("src", F.lit("CO_OCCURS_WITH").alias("rel"), "dst")


#: Hash buckets, by source concept, that stored co-occurrence edges lie in.
EDGE_BUCKETS = 256
EDGES = "src string, rel string, dst string, bucket int"


def _stamped(papers: DataFrame, as_of: dt.datetime) -> DataFrame:
    now = F.coalesce("cooccurrence_processed_at", F.lit(as_of).cast("timestamp"))
    return papers.withColumn("cooccurrence_processed_at", now)


def add_cooccurrence(target: DataFrame, found: DataFrame, papers: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The target edges with those of papers whose cooccurrence_processed_at is null, and the papers with that stamp set."""
    fresh = papers.where(F.col("cooccurrence_processed_at").isNull())
    return merge.insert_ignore(target, cooccurrence(found, fresh), ["src", "rel", "dst"]), _stamped(papers, as_of)


def extend_cooccurrence(spark: SparkSession, path: str, found: DataFrame, papers: DataFrame, as_of: dt.datetime, buckets: int = EDGE_BUCKETS) -> DataFrame:
    """Adds the co-occurrence edges of papers without a stamp to the table at `path`, and gives the papers with their stamp.

    Only pairs of unstamped papers are made. Edges are laid out by a hash of their source concept, so the pairs meet the edges of
    the buckets that they fall into, and what is new is appended there; no edge is written again. Papers are to be saved
    with their stamps after this; if that is lost, the next run makes the same pairs again and finds them all there.
    """
    fresh = papers.where(F.col("cooccurrence_processed_at").isNull())
    pairs = materialize(merge.with_bucket(cooccurrence(found, fresh), ["src"], buckets), "pairs")
    touched = sorted(r.bucket for r in pairs.select("bucket").distinct().collect())
    if touched:
        known = merge.read_partitions(spark, path, EDGES, "bucket", touched)
        new = materialize(pairs.join(known, ["bucket", "src", "rel", "dst"], "left_anti").select("src", "rel", "dst", "bucket"), "new-edges")
        new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return _stamped(papers, as_of)


def stored_cooccurrence(spark: SparkSession, path: str) -> DataFrame:
    return merge.read_partitions(spark, path, EDGES, "bucket").select("src", "rel", "dst")


def concept_subgraph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`src, dst` distinct between concepts, whatever the relation, with node and edge counts."""
    names = nodes.where("label = 'Concept'").select("key")
    pairs = links.join(names.select(F.col("key").alias("src")), "src", "left_semi").join(names.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    return pairs


def subgraph_size(pairs: DataFrame) -> DataFrame:
    """One row `graph_node_count, graph_edge_count`."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count("*").alias("graph_node_count"))
    return ends.crossJoin(pairs.agg(F.count("*").alias("graph_edge_count")))


def build_metrics(extractions: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """`arxiv_id, concepts_issued, edges_issued` per paper: what was asked for, repeats counted, empty names skipped."""
    def issued(field: str) -> Column:
        return F.size(F.filter(field, lambda x: sanitize(x) != ""))

    by = authors.groupBy(F.col("paper_id").alias("arxiv_id")).agg(F.count("*").alias("n_by"))
    cites = citations.where("citation_type = 'citation'").groupBy(F.col("source_arxiv_id").alias("arxiv_id")).agg(F.count("*").alias("n_cites"))
    own = extractions.select("arxiv_id", issued("concepts").alias("c"), issued("methods").alias("m"))
    return own.join(by, "arxiv_id", "left").join(cites, "arxiv_id", "left").select(
        "arxiv_id", (F.col("c") + F.col("m")).cast("long").alias("concepts_issued"),
        (F.col("c") + F.col("m") + F.coalesce("n_by", F.lit(0)) + F.coalesce("n_cites", F.lit(0))).alias("edges_issued"))


def counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`kind, n`: vertices by label and edges by relation."""
    return nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).union(links.groupBy("rel").agg(F.count("*")))


def _name_tokens(df: DataFrame) -> DataFrame:
    """`concept_name, token` with repeats, tokens over three characters."""
    return df.select("concept_name", F.explode(F.split(F.lower("concept_name"), r"\s+")).alias("token")).where(F.length("token") > 3)


def token_overlap_edges(signals: DataFrame, top: int = 100, cap: int = 200) -> DataFrame:
    """`source, target, weight` between the `top` concepts of the ranking: how many of the source's tokens the target has.

    The better ranked one is the source; the heaviest `cap` edges are listed.
    """
    best = signals.orderBy(F.desc("composite_score"), "concept_name").limit(top)
    ranked = best.select("concept_name", "composite_score", F.struct((-F.col("composite_score")).alias("s"), F.col("concept_name").alias("n")).alias("place"))
    a = _name_tokens(ranked).join(ranked.select("concept_name", F.col("place").alias("pa")), "concept_name").withColumnRenamed("concept_name", "source")
    b = _name_tokens(ranked).distinct().join(ranked.select("concept_name", F.col("place").alias("pb")), "concept_name").withColumnRenamed("concept_name", "target")
    pairs = a.join(b, "token").where("pa < pb").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return pairs.orderBy(F.desc("weight"), "source", "target").limit(cap)


#: A token of more concepts is not paired concept by concept.
HOT_TOKEN = 200
#: Concepts of one set of hot tokens are dealt over so many tasks.
SALTS = 32


def related_concepts(signals: DataFrame, k: int = 8, hot: int = HOT_TOKEN) -> DataFrame:
    """`concept_name, related, shared`: the k concepts that share most tokens with each.

    Pairs are made over tokens of at most `hot` concepts. Concepts with the same set of hotter tokens share as many of them
    with any other, so the best k + 1 names are found once a set; they fill the places that pairs leave, which is exact:
    whoever shares hot tokens only is behind nobody of its set but by name.
    """
    a = _name_tokens(signals).distinct()
    many = a.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("token", F.lit(True).alias("_hot"))
    marked = materialize(a.join(many, "token", "left"), "tokens")
    rare = marked.where("_hot IS NULL").select("concept_name", "token")
    sets = materialize(marked.where("_hot").groupBy("concept_name").agg(F.sort_array(F.collect_set("token")).alias("h")), "hot-sets")
    pairs = rare.join(rare.withColumnRenamed("concept_name", "related"), "token").where("concept_name <> related").groupBy("concept_name", "related").agg(F.count("*").alias("c"))
    none = F.array().cast("array<string>")
    both = pairs.join(sets, "concept_name", "left").join(sets.select(F.col("concept_name").alias("related"), F.col("h").alias("h2")), "related", "left").select(
        "concept_name", "related", (F.col("c") + F.size(F.array_intersect(F.coalesce("h", none), F.coalesce("h2", none)))).alias("shared"))
    # the first k + 1 names of each set, by way of those of each salt of it
    salt = F.pmod(F.xxhash64("concept_name"), F.lit(SALTS)).alias("salt")
    dealt = sets.select("h", "concept_name", salt)
    for part in (["h", "salt"], ["h"]):
        order = Window.partitionBy(*part).orderBy("concept_name")
        dealt = dealt.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
    names = materialize(dealt.select(F.col("h").alias("h2"), F.col("concept_name").alias("related")), "first-names")
    kinds = names.select(F.col("h2").alias("h")).distinct()
    near = kinds.select("h", F.explode("h").alias("token")).join(names.select("related", F.explode("h2").alias("token")), "token").groupBy("h", "related").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("h").orderBy(F.desc("shared"), "related")
    filling = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).select("h", "related", "shared", F.explode(F.array(*[F.lit(x).cast("long") for x in range(SALTS)])).alias("salt"))
    filled = sets.select("h", "concept_name", salt).join(filling, ["h", "salt"]).where("concept_name <> related").select("concept_name", "related", "shared")
    shared = both.union(filled).groupBy("concept_name", "related").agg(F.max("shared").alias("shared"))
    order = Window.partitionBy("concept_name").orderBy(F.desc("shared"), "related")
    return shared.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
