"""Listing and counting papers, users and runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.sources.papers import by_month, in_months


def list_papers(papers: DataFrame, category: str, days_back: int, limit: int, as_of: dt.datetime) -> DataFrame:
    """The newest papers of a category in the last days."""
    since = as_of - dt.timedelta(days=days_back)
    own = papers.where(F.array_contains("categories", category) & (F.col("published_at") >= F.lit(since)))
    return own.orderBy(F.desc("published_at"), "arxiv_id").limit(limit)


def count_papers(papers: DataFrame, categories: list[str] | None, days_back: int, as_of: dt.datetime) -> DataFrame:
    """`category, n` of the papers in the last days, for the given categories or all."""
    recent = papers.where(F.col("published_at") >= F.lit(as_of - dt.timedelta(days=days_back)))
    spread = recent.select(F.explode(F.array_distinct("categories")).alias("category"))
    if categories is not None:
        spread = spread.where(F.col("category").isin(categories))
    return spread.groupBy("category").agg(F.count("*").alias("n"))


def get_paper(papers: DataFrame, arxiv_id: str) -> DataFrame:
    return papers.where(F.col("arxiv_id") == arxiv_id)


def unprocessed(papers: DataFrame, stamp_col: str, limit: int | None = None) -> DataFrame:
    """Papers without the stamp, by id."""
    pending = papers.where(F.col(stamp_col).isNull())
    return pending if limit is None else pending.orderBy("id").limit(limit)


def published_between(papers: DataFrame, from_: dt.datetime, to: dt.datetime) -> DataFrame:
    """Papers of [from_, to). Of papers laid out by month (see `sources.papers.write_by_month`), only months in it are read."""
    return in_months(papers, from_, to).where((F.col("published_at") >= F.lit(from_)) & (F.col("published_at") < F.lit(to)))


def graph_stats(papers: DataFrame, vertices: DataFrame, edges: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: papers, processed ones, first and last publication, concepts, edges, last run."""
    p = papers.agg(F.count("*").alias("total_papers"), F.count("graph_processed_at").alias("processed_papers"), F.min("published_at").alias("first_published"), F.max("published_at").alias("last_published"))
    v = vertices.agg(F.count_if(F.col("label") == "Concept").alias("concepts"))
    e = edges.agg(F.count("*").alias("edges"))
    return p.crossJoin(v).crossJoin(e).crossJoin(reports.agg(F.max("generated_at").alias("last_run")))  # single rows


def admin_stats(users: DataFrame, papers: DataFrame, kc: DataFrame, scores: DataFrame, reports: DataFrame, as_of: dt.datetime, approximate: bool = False) -> DataFrame:
    """One row: users, admins, active in 7 days, papers, processed ones, distinct keywords, score rows, last report."""
    since = F.lit(as_of - dt.timedelta(days=7))
    u = users.agg(F.count("*").alias("users"), F.count_if("is_admin").alias("admins"), F.count_if(F.col("last_login") >= since).alias("active_users"))
    p = papers.agg(F.count("*").alias("papers"), F.count("graph_processed_at").alias("processed_papers"))
    distinct = F.approx_count_distinct("keyword") if approximate else F.countDistinct("keyword")
    k = kc.agg(distinct.alias("distinct_keywords"))
    return u.crossJoin(p).crossJoin(k).crossJoin(scores.agg(F.count("*").alias("score_rows"))).crossJoin(reports.agg(F.max("generated_at").alias("last_report")))  # single rows


def list_users(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "id")


def month_windows(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """`month, window_start, window_end`: calendar months of the range, the first and last clipped to it."""
    one = spark.range(1).select(F.lit(start).cast("timestamp").alias("s"), F.lit(end).cast("timestamp").alias("e"))
    months = one.select("s", "e", F.explode(F.expr("sequence(date_trunc('month', s), e, interval 1 month)")).alias("month"))
    return months.select("month", F.greatest("month", "s").alias("window_start"), F.least(F.expr("month + interval 1 month"), F.col("e")).alias("window_end"))


def papers_by_month(papers: DataFrame, windows: DataFrame) -> DataFrame:
    """`month, n`: papers in each window, its end included only at the range's end.

    Of papers laid out by month, the windows name the folders that are read: Spark prunes them while the query runs.
    """
    own = papers if "month" in papers.columns else by_month(papers)
    named = windows.select(F.col("month").alias("window_month"), F.to_date("month").alias("month"), "window_start", "window_end").where("window_start <= window_end")
    kept = own.select("published_at", "month").join(F.broadcast(named), "month")  # a row a month of the asked range
    return kept.where("published_at >= window_start AND published_at <= window_end").groupBy(F.col("window_month").alias("month")).agg(F.count("*").alias("n"))
