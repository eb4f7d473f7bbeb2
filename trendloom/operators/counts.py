"""Keyword counts per category and time bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_counts(paper_keywords: DataFrame, papers: DataFrame | None = None, window_date: dt.date | None = None) -> DataFrame:
    """`keyword, category, window_date, count` from `paper_keywords(arxiv_id, keyword)`.

    With `papers`, each paper adds one to each of its categories (none: "all") in the month it was
    published. Without, all counts stand under category "all" at `window_date`.
    """
    once = paper_keywords.select("arxiv_id", "keyword").distinct()
    if papers is None:
        return once.groupBy("keyword").agg(F.count("*").alias("count")).select(
            "keyword", F.lit("all").alias("category"), F.lit(window_date).cast("timestamp").alias("window_date"), "count")
    categories = F.when(F.size("categories") > 0, F.array_distinct("categories")).otherwise(F.array(F.lit("all")))
    meta = papers.select("arxiv_id", categories.alias("_categories"), F.date_trunc("month", "published_at").alias("window_date"))
    spread = once.join(meta, "arxiv_id").select("keyword", F.explode("_categories").alias("category"), "window_date")
    return spread.groupBy("keyword", "category", "window_date").agg(F.count("*").alias("count"))
