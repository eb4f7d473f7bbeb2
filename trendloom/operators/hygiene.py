"""Expiry, stale uploads and quotas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIFETIME_LIMIT, ACTIVE_LIMIT = 30, 10


def expired(users: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """`user_id` of users whose last login is older; one who never logged in doesn't expire."""
    return users.where(F.col("last_login") < F.lit(as_of - dt.timedelta(days=days))).select(F.col("id").alias("user_id"))


def expire_users(users: DataFrame, tables: dict[str, DataFrame], as_of: dt.datetime, days: int = 30) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows of expired users, and the upload paths to delete; users themselves stay."""
    gone = expired(users, as_of, days)
    kept = {name: df.join(gone, "user_id", "left_anti") for name, df in tables.items()}
    paths = tables["user_papers"].join(gone, "user_id", "left_semi").where(F.col("upload_path").isNotNull()).select("user_id", "upload_path")
    return kept, paths


def stale_uploads(user_papers: DataFrame, as_of: dt.datetime, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Paths of failed uploads older than that, and the table with those paths null."""
    stale = (F.col("status") == "failed") & F.col("upload_path").isNotNull() & (F.col("created_at") < F.lit(as_of - dt.timedelta(hours=hours)))
    stale = F.coalesce(stale, F.lit(False))
    return user_papers.where(stale).select("id", "upload_path"), user_papers.withColumn("upload_path", F.when(~stale, F.col("upload_path")))


def quota_audit(users: DataFrame, user_papers: DataFrame) -> DataFrame:
    """`user_id, lifetime_uploads, active, lifetime_reached, active_reached`."""
    active = user_papers.groupBy("user_id").agg(F.count_if(F.col("status").isin("pending", "processing", "processed")).alias("active"))
    return users.select(F.col("id").alias("user_id"), "lifetime_uploads").join(active, "user_id", "left").select(
        "user_id", "lifetime_uploads", F.coalesce("active", F.lit(0)).alias("active"),
        (F.col("lifetime_uploads") >= LIFETIME_LIMIT).alias("lifetime_reached"), (F.coalesce("active", F.lit(0)) >= ACTIVE_LIMIT).alias("active_reached"))
