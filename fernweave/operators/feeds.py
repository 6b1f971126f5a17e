"""Selections from parsed posts and entries: a thread, the replies to a post, posts with media, one post or user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thread(posts: DataFrame, post_id: str) -> DataFrame:
    """Posts of the conversation that a post began."""
    return posts.filter(F.col("conversation_id") == post_id)


def replies(posts: DataFrame, post_id: str) -> DataFrame:
    """Direct replies to a post."""
    return posts.filter(F.col("in_reply_to_id") == post_id)


def with_media(posts: DataFrame) -> DataFrame:
    """Posts with a photo, a video or an animation."""
    return posts.filter(F.size("photos") + F.size("videos") + F.size("animated") > 0)


def details(posts: DataFrame, post_id: str) -> DataFrame:
    return posts.filter(F.col("id_str") == post_id)


def only_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of pages that have just one."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def as_of_limit(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Whole pages until the limit is met: a page that begins under the limit is given whole.

    rows: keys, page_no and what they carry; the number of rows of earlier pages decides.
    """
    per_page = rows.groupBy(*keys, "page_no").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = per_page.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).filter(F.col("__before") < limit)
    return rows.join(kept.select(*keys, "page_no"), [*keys, "page_no"], "left_semi")
