"""Velocity and acceleration of concepts over weekly keyword counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words of a concept's name that match no keyword.
CONCEPT_STOPWORDS = "a an the of for in on with and or to from by as via using".split()


def concept_tokens(concepts: DataFrame) -> DataFrame:
    """`concept_name, token`: distinct lower-cased words over two characters that aren't stopwords; none left, the whole name."""
    lowered = F.lower("concept_name")
    words = F.filter(F.split(F.trim(lowered), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(CONCEPT_STOPWORDS))
    chosen = F.when(F.size(words) > 0, F.array_distinct(words)).otherwise(F.array(lowered))
    return concepts.select("concept_name").distinct().select("concept_name", F.explode(chosen).alias("token"))


def weekly_counts(tokens: DataFrame, kc: DataFrame) -> DataFrame:
    """`concept_name, week, weekly_count` over all categories; weeks start on Monday.

    Counts are summed per keyword and week before they meet the concepts.
    """
    weekly = kc.groupBy("keyword", F.date_trunc("week", "window_date").alias("week")).agg(F.sum("count").alias("n"))
    return tokens.join(weekly, tokens["token"] == weekly["keyword"]).groupBy("concept_name", "week").agg(F.sum("n").alias("weekly_count"))


def compute(concepts: DataFrame, kc: DataFrame, computed_at: dt.datetime) -> DataFrame:
    """`concept_name, velocity, acceleration, trend, weeks_of_data, computed_at`, a row per concept.

    velocity is the last week's change, acceleration the last change of changes (three weeks needed), trend
    follows the signs of the last two velocities. Weeks without data are not filled in.
    """
    weeks = weekly_counts(concept_tokens(concepts), kc)
    order = Window.partitionBy("concept_name").orderBy("week")
    moved = weeks.withColumn("v", F.col("weekly_count") - F.lag("weekly_count").over(order))
    moved = moved.withColumn("u", F.lag("v").over(order))
    last = moved.groupBy("concept_name").agg(F.max_by(F.struct("v", "u"), "week").alias("_l"), F.count("*").cast("int").alias("weeks_of_data"))
    v, u = F.col("_l.v"), F.col("_l.u")
    trend = F.when((v > 0) & (u > 0), "accelerating").when((v < 0) & (u < 0), "decelerating").otherwise("stable")
    return concepts.select("concept_name").distinct().join(last, "concept_name", "left").select(
        "concept_name", F.coalesce(v.cast("double"), F.lit(0.0)).alias("velocity"), F.coalesce((v - u).cast("double"), F.lit(0.0)).alias("acceleration"),
        trend.alias("trend"), F.coalesce("weeks_of_data", F.lit(0)).alias("weeks_of_data"), F.lit(computed_at).cast("timestamp").alias("computed_at"))
