"""Per-user concept graphs, for all users in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators.placing import numbered, top_rows
from trendloom.sources import merge
from trendloom.storage import materialize


def _rounded(x: Column) -> Column:
    """`F.round(x, 6)` of a double. Where millionths aren't near a half, and are few enough that doubles tell them apart, plain arithmetic gives the same double as decimals, in a fraction of the time."""
    y = x * F.lit(1e6)
    plain = (F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - F.lit(0.5)) > 1e-6)
    return F.when(plain, F.floor(y + F.lit(0.5)) / F.lit(1e6)).otherwise(F.round(x, 6))


#: Documents whose pairs a task makes, about.
PAIRED = 4096


def concept_edges(concepts: DataFrame, top: int = 20, key: str = "paper_id") -> DataFrame:
    """`key, source_concept, target_concept, weight`: all pairs of a document's `top` concepts in rank order.

    Pairs are made inside the document's array (at most `top` long), weight is the product to 6 digits. The lists are small, so Spark would join
    many of them into a task, and what their pairs hold when they are grouped next would grow with the table: they are written once, counted and dealt out by PAIRED.
    """
    best = concepts.where(F.col("rank") <= top).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "concept", "weight"))).alias("c"))
    best = materialize(best, "best-concepts")
    tasks = max(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-best.count() // PAIRED))
    left = best.repartition(tasks, key).select(key, "c", F.explode("c").alias("a"))
    pairs = left.select(key, "a", F.explode(F.filter("c", lambda x: x["rank"] > F.col("a.rank"))).alias("b"))
    return pairs.select(key, F.col("a.concept").alias("source_concept"), F.col("b.concept").alias("target_concept"), _rounded(F.col("a.weight") * F.col("b.weight")).alias("weight"))


def nodes(user_concepts: DataFrame, limit: int = 200) -> DataFrame:
    """`user_id, concept, weight, mentions, total_concepts`: each user's heaviest concepts."""
    grouped = user_concepts.groupBy("user_id", "concept").agg(F.sum("weight").alias("raw"), F.count("*").alias("mentions"))
    grouped = materialize(grouped, "user-concepts")
    totals = grouped.groupBy(F.col("user_id").alias("owner")).agg(F.count("*").alias("total_concepts"))
    best = top_rows(grouped, ["user_id"], [F.desc("raw"), "concept"], limit)
    return best.join(totals, F.col("user_id").eqNullSafe(F.col("owner"))).select("user_id", "concept", F.round("raw", 6).alias("weight"), "mentions", "total_concepts")


def edges(kept: DataFrame, user_edges: DataFrame) -> DataFrame:
    """Edges whose ends are both among the user's nodes; of the two directions the first seen stays."""
    ends = kept.select("user_id", "concept")
    both = user_edges.join(ends.withColumnRenamed("concept", "source_concept"), ["user_id", "source_concept"], "left_semi").join(
        ends.withColumnRenamed("concept", "target_concept"), ["user_id", "target_concept"], "left_semi")
    pair = both.withColumns({"_a": F.least("source_concept", "target_concept"), "_b": F.greatest("source_concept", "target_concept")})
    return merge.first_seen(pair, ["user_id", "_a", "_b"], ["paper_id", "source_concept", "target_concept"]).select(
        "user_id", "source_concept", "target_concept", "weight")


def neighbours(kept: DataFrame, links: DataFrame, k: int = 8) -> DataFrame:
    """`user_id, concept, neighbour, weight`: the k heaviest neighbours over undirected edges."""
    there = links.select("user_id", F.col("source_concept").alias("concept"), F.col("target_concept").alias("neighbour"), "weight")
    back = links.select("user_id", F.col("target_concept").alias("concept"), F.col("source_concept").alias("neighbour"), "weight")
    both = there.union(back).join(kept.select("user_id", F.col("concept").alias("neighbour")), ["user_id", "neighbour"], "left_semi")
    return top_rows(both, ["user_id", "concept"], [F.desc("weight"), "neighbour"], k).select("user_id", "concept", "neighbour", "weight")


def prominence(user_concepts: DataFrame, limit: int = 200) -> DataFrame:
    """`user_id, concept, weight, coverage, velocity, acceleration, composite, trend` of each user's heaviest concepts."""
    grouped = user_concepts.groupBy("user_id", "concept").agg(F.sum("weight").alias("weight"), F.countDistinct("paper_id").alias("papers"))
    totals = user_concepts.groupBy("user_id").agg(F.countDistinct("paper_id").alias("total"))
    best = top_rows(grouped, ["user_id"], [F.desc("weight"), "concept"], limit).join(totals, "user_id")
    coverage = best.withColumn("coverage", F.col("papers") / F.col("total")).withColumn("velocity", F.round(F.col("weight") * 1000, 1))
    trend = F.when(F.col("coverage") >= 0.8, "stable").when((F.col("coverage") >= 0.4) | (F.col("weight") > 0.01), "accelerating").otherwise("decelerating")
    return coverage.select(
        "user_id", "concept", "weight", "coverage", "velocity", F.round(F.col("coverage") * 50, 1).alias("acceleration"),
        F.round(F.col("velocity") * F.col("coverage"), 2).alias("composite"), trend.alias("trend"))


#: Edges that a task groups, about.
GROUPED = 1 << 20


def top_pairs(user_edges: DataFrame, k: int = 15) -> DataFrame:
    """`user_id, concept_a, concept_b, weight`: heaviest unordered pairs, all their edges summed, 5 digits.

    Edges are counted first: where the session's partitions are too few for them, they are dealt to as many as keep a task's groups at about GROUPED.
    """
    key = ["user_id", "concept_a", "concept_b"]
    pairs = user_edges.select("user_id", F.least("source_concept", "target_concept").alias("concept_a"), F.greatest("source_concept", "target_concept").alias("concept_b"), "weight")
    tasks = -(-user_edges.count() // GROUPED)
    if tasks > int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.repartition(tasks, *key)
    return top_rows(pairs.groupBy(*key).agg(F.sum("weight").alias("raw")), ["user_id"], [F.desc("raw"), "concept_a", "concept_b"], k).select(*key, F.round("raw", 5).alias("weight"))


def top_concepts(user_concepts: DataFrame, k: int = 20) -> DataFrame:
    """`user_id, concept, weight`: heaviest concepts, 4 digits."""
    sums = user_concepts.groupBy("user_id", "concept").agg(F.sum("weight").alias("raw"))
    return top_rows(sums, ["user_id"], [F.desc("raw"), "concept"], k).select("user_id", "concept", F.round("raw", 4).alias("weight"))


def list_uploads(user_papers: DataFrame, user_id: int) -> DataFrame:
    return user_papers.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "id")


#: Papers of an exported document at most.
EXPORT_PAPERS = 100


CONCEPT, EDGE = ["paper_id", "concept", "weight"], ["paper_id", "source_concept", "target_concept", "weight"]


def _documents(papers: DataFrame, concepts: Column, edges: Column) -> DataFrame:
    """JSON documents of `papers(user_id, paper_id, ...)`, a row a paper, which are written once; `concepts` and `edges` are lists made of `p`, a part's papers in order.

    Only ids are numbered; the papers move twice, to their parts' numbers and to their parts.
    """
    papers = materialize(papers, "export-papers")
    parts = numbered(papers.select("user_id", "paper_id"), ["user_id"], ["paper_id"], "place").select(F.col("user_id").alias("_user"), F.col("paper_id").alias("_paper"), F.floor(F.col("place") / EXPORT_PAPERS).cast("int").alias("part"))
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("paper_id").eqNullSafe(F.col("_paper"))
    own = F.struct("paper_id", *[c for c in papers.columns if c not in ("user_id", "paper_id")])
    lists = papers.join(parts, same).groupBy("user_id", "part").agg(F.sort_array(F.collect_list(own)).alias("p"))
    return lists.select("user_id", "part", F.to_json(F.struct("user_id", concepts.alias("concepts"), edges.alias("edges"))).alias("document"))


def export_json(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """`user_id, part, document`: JSON documents with each user's concepts and edges, EXPORT_PAPERS papers a part.

    Parts follow the order of paper_id; rows without a paper's id are in part 0. A paper's concepts and edges are bounded, so no row grows with the table.
    """
    key = ["user_id", "paper_id"]
    c = concepts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*CONCEPT))).alias("concepts")).alias("c")
    e = links.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*EDGE))).alias("edges")).alias("e")
    both = c.join(e, F.col("c.user_id").eqNullSafe(F.col("e.user_id")) & F.col("c.paper_id").eqNullSafe(F.col("e.paper_id")), "full")
    whole = [F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name) for name, df in (("concepts", c), ("edges", e))]
    return _documents(both.select(*[F.coalesce(f"c.{k}", f"e.{k}").alias(k) for k in key], *whole), F.flatten("p.concepts"), F.flatten("p.edges"))


def export_graphs(concepts: DataFrame, top: int = 20) -> DataFrame:
    """`export_json` of `concepts(user_id, paper_id, concept, weight, rank)` and their `concept_edges`, which are made in the documents: no edge is a row or is moved."""
    listed = concepts.groupBy("user_id", "paper_id").agg(F.sort_array(F.collect_list(F.struct("rank", "concept", "weight"))).alias("c"))
    best = F.transform(F.filter("c", lambda x: x["rank"] <= top), lambda x: F.struct(x["concept"].alias("concept"), x["rank"].alias("rank"), x["weight"].alias("weight")))
    papers = listed.select("user_id", "paper_id", F.sort_array(F.transform("c", lambda x: F.struct(x["concept"].alias("concept"), x["weight"].alias("weight")))).alias("c"), F.sort_array(best).alias("best"))

    def edge(p: Column, a: Column, b: Column) -> Column:
        return F.struct(p["paper_id"].alias("paper_id"), a["concept"].alias("source_concept"), b["concept"].alias("target_concept"), _rounded(a["weight"] * b["weight"]).alias("weight"))

    def edges(p: Column) -> Column:  # which come in order from concepts in order: the sort compares neighbours, and moves only what a concept listed twice has
        return F.sort_array(F.flatten(F.transform(p["best"], lambda a: F.transform(F.filter(p["best"], lambda b: b["rank"] > a["rank"]), lambda b: edge(p, a, b)))))

    own = F.transform("p", lambda p: F.transform(p["c"], lambda x: F.struct(p["paper_id"].alias("paper_id"), x["concept"].alias("concept"), x["weight"].alias("weight"))))
    return _documents(papers, F.flatten(own), F.flatten(F.transform("p", edges)))


def process(pages: DataFrame, top_n: int = 50, top_edges: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page texts to (status, concepts, edges): a document of white space only fails with a message."""
    docs = text.join_pages(pages)
    concepts = text.weighted_concepts(docs.where("status = 'processed'"), top_n)
    counts = concepts.groupBy("paper_id").agg(F.count("*").alias("concept_count"))
    message = F.when(F.col("status") == "failed", F.substring(F.lit("PDF contains no extractable text"), 1, 500))
    status = docs.join(counts, "paper_id", "left").select("paper_id", "status", F.coalesce("concept_count", F.lit(0)).alias("concept_count"), message.alias("error_msg"))
    return status, concepts, concept_edges(concepts, top_edges)
