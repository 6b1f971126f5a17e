"""Engagement metrics of accounts from a sample of their newest qualifying posts, always derived, never accumulated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Qualifying posts of a sample.
TARGET_POSTS = 30
KEYS = ["task_id", "account_id"]


def newest_sample(posts: DataFrame, target_posts: int = TARGET_POSTS) -> DataFrame:
    """The newest qualifying posts of each account. Spark limits each task's rows by rank before the shuffle."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("posted_at").desc_nulls_last(), "post_id")
    return posts.filter("is_qualifying").withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= target_posts).drop("__rank")


def account_metrics(posts: DataFrame, profiles: DataFrame, target_posts: int = TARGET_POSTS) -> DataFrame:
    """One row for every account with posts, sampled or not.

    A missing view count is not a zero: means and rates of views cover the posts that have one, the median of
    engagement covers all sampled posts. Rates are ratios of sums.
    """
    seen = F.col("view_count").isNotNull()
    engaged = F.col("reply_count") + F.col("retweet_count") + F.col("like_count")
    views = F.nullif(F.sum("view_count"), F.lit(0))
    sampled = (
        newest_sample(posts, target_posts)
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            ((F.unix_micros(F.max("posted_at").cast("timestamp")) - F.unix_micros(F.min("posted_at").cast("timestamp"))) / 86_400_000_000).alias("sample_span_days"),
            F.max("posted_at").alias("latest_post_at"),
            F.avg("reply_count").alias("avg_reply"),
            F.avg("retweet_count").alias("avg_retweet"),
            F.avg("like_count").alias("avg_like"),
            F.avg("view_count").alias("avg_view"),
            F.count("view_count").alias("view_sample_count"),
            F.percentile(engaged, 0.5).alias("median_engagement"),
            (F.sum(F.when(seen, engaged)) / views).alias("engagement_rate"),
            (F.sum(F.when(seen, F.col("bookmark_count"))) / views).alias("bookmark_rate"),
        )
    )
    scanned = posts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("scanned_count"))
    rows = scanned.join(sampled, KEYS, "left").join(profiles.select(*KEYS, "followers_count"), KEYS, "left")
    filled = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("sample_count", "view_sample_count")}
    reach = F.col("avg_view") / F.nullif("followers_count", F.lit(0))
    ordered = ["sample_count", "scanned_count", "sample_span_days", "latest_post_at", "avg_reply", "avg_retweet", "avg_like", "avg_view", "view_sample_count", "median_engagement", "engagement_rate", "reach_ratio", "bookmark_rate"]
    return rows.withColumns(filled | {"reach_ratio": reach}).select(*KEYS, *ordered)


def qualifying_progress(posts: DataFrame) -> DataFrame:
    """Posts seen of each account, and how many of them qualify."""
    return posts.groupBy(*KEYS).agg(F.count_if("is_qualifying").alias("qualifying"), F.count(F.lit(1)).alias("scanned"))


def metrics_of(metrics: DataFrame, task_id: str, account_id: str) -> DataFrame:
    """One account's metrics; no row if there are none."""
    return metrics.filter((F.col("task_id") == task_id) & (F.col("account_id") == account_id))
