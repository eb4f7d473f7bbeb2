"""Ranking concepts by centrality and velocity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import corpus
from trendloom.operators.placing import top_rows
from trendloom.sources.papers import in_months

CENTRALITY_SHARE, VELOCITY_SHARE = 0.6, 0.4
TRENDS = ("accelerating", "decelerating", "stable")


def minmax(df: DataFrame, *columns: str) -> DataFrame:
    """Adds `norm_<column>` in [0, 1] over the whole table; a zero range gives 0.

    The bounds are one aggregated row, joined back; no window holds the table.
    """
    bounds = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    both = df.crossJoin(F.broadcast(bounds))  # one row

    def norm(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    return both.withColumns({f"norm_{c}": norm(c) for c in columns}).drop(*bounds.columns)


def _composite(df: DataFrame, left: str = "centrality_score") -> DataFrame:
    both = minmax(df, left, "velocity")
    return both.withColumn("composite_score", CENTRALITY_SHARE * F.col(f"norm_{left}") + VELOCITY_SHARE * F.col("norm_velocity")).drop(f"norm_{left}", "norm_velocity")


def combine(bridge: DataFrame, velocity: DataFrame) -> DataFrame:
    """Every bridge row with its velocity; missing ones are 0, 0, stable."""
    v = velocity.select("concept_name", "velocity", "acceleration", "trend")
    return bridge.join(v, "concept_name", "left").withColumns({
        "velocity": F.coalesce("velocity", F.lit(0.0)), "acceleration": F.coalesce("acceleration", F.lit(0.0)), "trend": F.coalesce("trend", F.lit("stable"))})


def score(bridge: DataFrame, velocity: DataFrame) -> DataFrame:
    """Every concept with 0.6 normalised centrality + 0.4 normalised velocity, in no order."""
    return _composite(combine(bridge, velocity))


def rank(bridge: DataFrame, velocity: DataFrame, top_n: int = 200) -> DataFrame:
    """The best concepts by that score, which is normalised over all rows."""
    return score(bridge, velocity).orderBy(F.desc("composite_score"), "concept_name").limit(top_n)


def page(bridge: DataFrame, velocity: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of that ranking; the normalisation stays that of the whole."""
    return score(bridge, velocity).orderBy(F.desc("composite_score"), "concept_name").offset(offset).limit(limit)


def query_graph(bridge: DataFrame, velocity: DataFrame, top_n: int = 20, trend: str = "all") -> DataFrame:
    """Concepts with both scores, filtered by trend before they are normalised; composite rounded to 6 digits."""
    both = filter_trend(bridge.join(velocity.select("concept_name", "velocity", "acceleration", "trend"), "concept_name"), trend)
    return _composite(both).withColumn("composite_score", F.round("composite_score", 6)).orderBy(F.desc("composite_score"), "concept_name").limit(top_n)


def filter_trend(df: DataFrame, trend: str = "all") -> DataFrame:
    return df if trend == "all" else df.where(F.col("trend") == trend)


def mention_counts(papers: DataFrame, mentions: DataFrame, from_: dt.datetime, to: dt.datetime) -> DataFrame:
    """`concept_name, mentions` over papers published in [from_, to), from `mentions(arxiv_id, concept_name)`.

    Of papers laid out by month, and of mentions with their paper's month, only months in the range are read, and a mention meets the papers of its month.
    """
    key = ["arxiv_id", "month"] if "month" in papers.columns and "month" in mentions.columns else ["arxiv_id"]
    inside = corpus.published_between(papers, from_, to).select(*key)
    return in_months(mentions, from_, to).join(inside, key, "left_semi").groupBy("concept_name").agg(F.count("*").alias("mentions"))


def for_date_range(papers: DataFrame, mentions: DataFrame, velocity: DataFrame, from_: dt.datetime, to: dt.datetime, top_n: int) -> DataFrame:
    """The ranking with mention counts in place of centrality, normalised within the 3 top_n most mentioned."""
    counts = mention_counts(papers, mentions, from_, to).orderBy(F.desc("mentions"), "concept_name").limit(3 * top_n)
    both = combine(counts.withColumn("centrality_score", F.col("mentions").cast("double")), velocity)
    return _composite(both).orderBy(F.desc("composite_score"), "concept_name").limit(top_n)


def dedup_case(df: DataFrame) -> DataFrame:
    """One row per concept whatever its case, that of the highest composite, with a display name and the scale (1 at least)."""
    best = df.groupBy(F.lower("concept_name").alias("concept_key")).agg(F.max_by(F.struct("*"), F.struct("composite_score", "concept_name")).alias("_r"))
    flat = best.select("concept_key", "_r.*")
    words = F.transform(F.split("concept_key", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    top = flat.agg(F.greatest(F.coalesce(F.max("composite_score"), F.lit(1.0)), F.lit(1.0)).alias("max_score"))
    return flat.withColumn("display_name", F.array_join(words, " ")).crossJoin(F.broadcast(top))  # one row


def trend_counts(df: DataFrame) -> DataFrame:
    """`trend, n` for the three trends, zeros kept."""
    counts = df.groupBy("trend").agg(F.count("*").alias("n"))
    fixed = df.sparkSession.createDataFrame([(t,) for t in TRENDS], "trend string")
    return fixed.join(counts, "trend", "left").select("trend", F.coalesce("n", F.lit(0)).alias("n"))


def top(df: DataFrame, by: str, n: int, per: str | None = None, tie: str = "concept_name") -> DataFrame:
    """The n rows with the highest `by`, of the whole table or of each `per`."""
    if per is None:
        return df.orderBy(F.desc(by), tie).limit(n)
    return top_rows(df, [per], [F.desc(by), tie], n)


def sort_by(df: DataFrame, column: str, ascending: bool = False, limit: int | None = None, tie: str = "concept_name") -> DataFrame:
    ordered = df.orderBy(F.asc(column) if ascending else F.desc(column), tie)
    return ordered if limit is None else ordered.limit(limit)
