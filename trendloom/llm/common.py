"""What several operators share: written intermediates, fixed columns, component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.storage import fresh_path, materialize, spread

__all__ = ["components", "fresh_path", "materialize", "only_columns", "spread"]


def only_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """The `required` columns (name: type) under their names, whatever others there are."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in required.items()])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as `edges(a long, b long)`.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edge set stays:
    O(log^2 n) rounds, each two aggregations and two joins. Every node of a component then points
    at its smallest member. Returns `node, root`, roots included; no edges give no rows.
    A hub's edges are never gathered: minima are pre-aggregated, and what joins them is an
    equi-join that Spark can split.
    """
    def fingerprint(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    seen = fingerprint(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(low).distinct()
        edges = materialize(small, "edges")
        now = fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b"), F.col("b"))).distinct()
