"""Exports of accounts, relationships and posts, as CSV or JSON, each with a manifest of where it comes from.

An export is the query itself without its page, written by the tasks; nothing is paged through or collected. A folder
holds `rows` (the parts of the file, in the order of the list) and `manifest` (one JSON object).
"""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.operators import layers
from fernweave.operators.listing import AccountFilter, EdgeFilter, all_accounts, of_task, relationship_rows

# The columns of each export, in order.
ACCOUNT_COLUMNS = (
    "account_id", "username", "display_name", "first_depth", "seed_of_tree", "trees", "network_indegree", "observation_count", "collision_count", "followers_count",
    "following_count", "can_dm", "verified", "blue_verified", "protected", "location", "description", "expansion_status", "declared_following", "collected_following",
    "coverage_ratio", "termination_reason", "timeline_reason", "is_l6_boundary", "timeline_status", "candidate_reasons", "sample_count", "scanned_count",
    "sample_span_days", "latest_post_at", "avg_reply", "avg_retweet", "avg_like", "avg_view", "view_sample_count", "median_engagement", "engagement_rate",
    "reach_ratio", "bookmark_rate", "warnings",
)
EDGE_COLUMNS = ("source_account_id", "target_account_id", "source_depth", "target_depth", "trees", "is_collision", "is_l6_boundary", "first_seen_at")
POST_COLUMNS = ("account_id", "post_id", "kind", "is_qualifying", "posted_at", "reply_count", "retweet_count", "like_count", "quote_count", "bookmark_count", "view_count", "text")


def cell(df: DataFrame, name: str) -> Column:
    """A value as a cell of a table: nothing for null, true and false, lists joined by |, ISO 8601 for moments."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: x.cast("string")), "|")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX" if isinstance(kind, T.TimestampType) else "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("")).alias(name)


def as_cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell(df, c) for c in df.columns])


def accounts(frames: dict[str, DataFrame], task_id: str, wanted: AccountFilter) -> DataFrame:
    rows = all_accounts(frames, task_id, wanted)
    return rows.select(*ACCOUNT_COLUMNS)


def relationships(frames: dict[str, DataFrame], task_id: str, wanted: EdgeFilter) -> DataFrame:
    rows = relationship_rows(frames, task_id, wanted).select(*EDGE_COLUMNS).orderBy("source_account_id", "target_account_id")
    return rows.offset(wanted.offset) if wanted.offset else rows


def posts(frames: dict[str, DataFrame], task_id: str) -> DataFrame:
    """All posts, those that don't qualify too, by account and newest first."""
    return of_task(frames["account_posts"], task_id).select(*POST_COLUMNS).orderBy("account_id", F.col("posted_at").desc_nulls_last(), "post_id")


def manifest(frames: dict[str, DataFrame], task_id: str, dataset: str, filters: dict[str, Any], row_count: int, generated_at: datetime, as_of: str, parser_group: str) -> dict[str, Any]:
    """What a reader of the file has to know about it. All of it is aggregates of a row or a few."""
    task = frames["crawl_tasks"].filter(F.col("task_id") == task_id).select("status", (F.col("pages_produced") - F.col("pages_processed")).alias("backlog")).head()
    if task is None:
        raise LookupError(f"unknown task {task_id}")
    own = {name: df.filter(F.col("task_id") == task_id) if "task_id" in df.columns else df for name, df in frames.items()}
    done = layers.expansion_complete(own, as_of, parser_group).head()
    cover = layers.coverage(own["account_nodes"]).drop("task_id").head()
    reasons = {r["reason"]: r["n"] for r in layers.termination_histogram(own["account_nodes"]).collect()}
    return {
        "task_id": task_id,
        "dataset": dataset,
        "filters": filters,
        "generated_at": generated_at.isoformat(),
        "row_count": row_count,
        "task_status": task["status"],
        "expansion_complete": bool(done and done["expansion_complete"]),
        "parser_backlog": task["backlog"],
        "coverage": ({} if cover is None else cover.asDict()) | {"termination_reasons": reasons},
    }


def write(df: DataFrame, told: dict[str, Any], path: str, kind: str = "csv") -> None:
    """df and its manifest under path. CSV has cells as text; JSON keeps lists, numbers and nulls as they are."""
    if kind == "csv":
        as_cells(df).write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(f"{path}/rows")
    elif kind == "json":
        df.write.option("ignoreNullFields", "false").json(f"{path}/rows")
    else:
        raise ValueError("kind must be csv or json")
    df.sparkSession.createDataFrame([(json.dumps(told, default=str),)], "value string").coalesce(1).write.text(f"{path}/manifest")
