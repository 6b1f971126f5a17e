"""The tables of the model, as DDL. Ids are strings everywhere and every table is keyed by task first.

Parquet under a warehouse path is partitioned by task_id, so a query about one task reads that task's files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns and types of the model's tables.
TABLES = {
    "crawl_tasks": "task_id string, status string, current_depth int, max_depth int, min_followers_to_expand int, timeline_enabled boolean, max_requests bigint, max_nodes bigint, max_edges bigint, requests_attempted bigint, nodes_created bigint, edges_created bigint, pages_produced bigint, pages_processed bigint, created_at timestamp, updated_at timestamp",
    "root_trees": "task_id string, tree_id string, seed_account_id string, status string",
    "account_nodes": "task_id string, account_id string, first_depth int, is_l6_boundary boolean, expansion_status string, declared_following int, collected_following int, termination_reason string, timeline_reason string, network_indegree int, filter_reason string, timeline_status string, candidate_reasons array<string>, first_seen_at timestamp, updated_at timestamp",
    "account_profiles": "task_id string, account_id string, username string, display_name string, description string, location string, followers_count int, following_count int, created_at timestamp, protected boolean, verified boolean, blue_verified boolean, can_dm boolean, observed_at timestamp",
    "account_observations": "task_id string, tree_id string, account_id string, parent_account_id string, depth int, is_collision boolean, observed_at timestamp",
    "follow_edges": "task_id string, source_account_id string, target_account_id string, source_depth int, target_depth int, is_l6_boundary boolean, first_seen_at timestamp",
    "follow_edge_observations": "task_id string, tree_id string, source_account_id string, target_account_id string, source_depth int, target_depth int, is_collision boolean",
    "account_posts": "task_id string, account_id string, post_id string, kind string, is_qualifying boolean, text string, posted_at timestamp, reply_count int, retweet_count int, like_count int, quote_count int, bookmark_count int, view_count int, conversation_id string, in_reply_to_tweet_id string, quoted_tweet_id string, retweeted_tweet_id string",
    "account_metrics": "task_id string, account_id string, sample_count bigint, scanned_count bigint, sample_span_days double, latest_post_at timestamp, avg_reply double, avg_retweet double, avg_like double, avg_view double, view_sample_count bigint, median_engagement double, engagement_rate double, reach_ratio double, bookmark_rate double",
    "crawl_frontier": "frontier_id bigint, task_id string, tree_id string, account_id string, operation string, depth int, priority int, status string, attempt int, max_attempts int, cursor_in string, owner_id string, lease_expires_at timestamp, not_before timestamp, last_error_class string",
    "task_operation_budgets": "task_id string, operation string, max_requests bigint, requests_attempted bigint",
    "request_attempts": "attempt_id string, task_id string, frontier_id bigint, operation string, scraper_alias string, outcome string, error_class string, started_at timestamp",
    "raw_page_outbox": "task_id string, event_id string, tree_id string, account_id string, operation string, depth int, payload string, attempts int, created_at timestamp, published_at timestamp, dead_lettered_at timestamp, lease_expires_at timestamp, not_before timestamp, last_error string",
    "processed_events": "group_id string, task_id string, event_id string",
    "consumer_offsets": "group_id string, topic string, partition int, committed_offset bigint, epoch bigint",
    "dlq_events": "task_id string, event_id string, topic string, partition int, offset bigint, error_class string, detail string, payload string",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order and of its types; columns that it lacks are null, further ones go."""
    names = [part.strip().split(" ", 1) for part in TABLES[table].split(", ")]
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in names])


def read(spark: SparkSession, warehouse: str, table: str) -> DataFrame:
    """A table of a warehouse folder; files written before a column was added give null there."""
    return conformed(spark.read.option("mergeSchema", "true").parquet(f"{warehouse}/{table}"), table)


def write(df: DataFrame, warehouse: str, table: str, mode: str = "append") -> None:
    conformed(df, table).write.mode(mode).partitionBy("task_id").parquet(f"{warehouse}/{table}")
