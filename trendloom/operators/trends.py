"""Trending keywords, slopes and trend scores over keyword counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _since(kc: DataFrame, days: int, as_of: dt.datetime) -> DataFrame:
    start = as_of - dt.timedelta(days=days)
    return kc.where((F.col("window_date") >= F.lit(start)) & (F.col("window_date") <= F.lit(as_of)))


def trending(kc: DataFrame, category: str | None = None, window_days: int = 7, top_n: int = 20, as_of: dt.datetime | None = None) -> DataFrame:
    """`keyword, category, window_date, total, rank`: largest sums per category (all of them, or one) in the last days.

    A keyword may stand there with several dates.
    """
    recent = _since(kc, window_days, as_of)
    if category is not None:
        recent = recent.where(F.col("category") == category)
    totals = recent.groupBy("keyword", "category", "window_date").agg(F.sum("count").alias("total"))
    order = Window.partitionBy("category").orderBy(F.desc("total"), "keyword", "window_date")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def keyword_slope(kc: DataFrame, window_days: int = 30, as_of: dt.datetime | None = None) -> DataFrame:
    """`keyword, category, slope, n_days`: least-squares slope of daily totals over their index; below two days 0."""
    totals = _since(kc, window_days, as_of).groupBy("keyword", "category", "window_date").agg(F.sum("count").alias("total"))
    order = Window.partitionBy("keyword", "category").orderBy("window_date")
    placed = totals.withColumn("x", (F.row_number().over(order) - 1).cast("double"))
    return placed.groupBy("keyword", "category").agg(
        F.coalesce(F.regr_slope(F.col("total").cast("double"), F.col("x")), F.lit(0.0)).alias("slope"), F.count("*").alias("n_days"))


def score(kc: DataFrame, window_date: dt.datetime, as_of: dt.datetime, top_n: int = 20) -> DataFrame:
    """`keyword, category, score, trend_direction, window_start, window_end` of each category's leading keywords."""
    top = trending(kc, None, 7, top_n, as_of).select("keyword", "category").distinct()
    slopes = keyword_slope(kc, 30, as_of)
    direction = F.when(F.col("slope") > 0.5, "rising").when(F.col("slope") < -0.5, "falling").otherwise("stable")
    day = F.date_trunc("day", F.lit(window_date))
    return top.join(slopes, ["keyword", "category"]).select(
        "keyword", "category", F.col("slope").alias("score"), direction.alias("trend_direction"),
        day.alias("window_start"), (day + F.expr("INTERVAL 1 DAY")).alias("window_end"))


def summary(scores: DataFrame, kc: DataFrame, category: str, limit: int = 10, latest_only: bool = True) -> DataFrame:
    """Leading scores of a category with total count and the counts per day in date order.

    `latest_only` takes each keyword's latest score; otherwise a keyword may repeat.
    """
    own = scores.where(F.col("category") == category)
    if latest_only:
        last = Window.partitionBy("keyword").orderBy(F.desc("window_start"))
        own = own.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    top = own.orderBy(F.desc("score"), "keyword", "window_start").limit(limit)
    daily = kc.where(F.col("category") == category).groupBy("keyword", "window_date").agg(F.sum("count").alias("_c"))
    series = daily.join(top.select("keyword").distinct(), "keyword", "left_semi").groupBy("keyword").agg(
        F.sum("_c").alias("total_count"), F.sort_array(F.collect_list(F.struct("window_date", "_c"))).alias("_s"))
    return top.join(series, "keyword", "left").select(
        "keyword", "category", "score", "trend_direction", "window_start",
        F.coalesce("total_count", F.lit(0)).alias("total_count"), F.coalesce(F.col("_s._c"), F.array().cast("array<bigint>")).alias("daily_counts"))


def _prefix(keyword: str = "keyword") -> F.Column:
    """The group of a keyword: its first four characters, or itself if it is shorter."""
    return F.when(F.length(keyword) >= 4, F.concat(F.lit("4:"), F.substring(keyword, 1, 4))).otherwise(F.concat(F.lit("s:"), F.col(keyword)))


def prefix_members(keywords: DataFrame) -> DataFrame:
    """`label, pos, keyword`: one row per member of each cluster of `keywords(pos, keyword)`, so that no row grows with a cluster.

    Keywords that share their first four characters are a cluster, whose label is its earliest member (by pos, then keyword). A shorter keyword
    is a cluster of its own with its first row alone. Labels are found by pre-aggregated minima and joined to the rows.
    """
    placed = keywords.select("pos", "keyword", _prefix().alias("prefix"))
    first = placed.groupBy(F.col("prefix").alias("of")).agg(F.min(F.struct("pos", "keyword")).alias("first"))
    long = placed.where(F.length("keyword") >= 4).join(first, F.col("prefix") == F.col("of")).select(F.col("first.keyword").alias("label"), "pos", "keyword")
    short = first.where(F.col("of").startswith("s:")).select(F.col("first.keyword").alias("label"), "first.pos", "first.keyword")
    return long.union(short)


def prefix_clusters(keywords: DataFrame) -> DataFrame:
    """`label, members` of `keywords(pos, keyword)`: keywords that share their first four characters.

    The label is the earliest member; members keep input order. A shorter keyword is a cluster of its own,
    once however often it comes. A row holds a whole cluster; `prefix_members` has a row per member instead.
    """
    grouped = prefix_members(keywords).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "keyword"))).alias("m"))
    return grouped.select("label", F.col("m.keyword").alias("members"))
