"""The graph's tables as they follow from the facts that a stream has stored.

Nothing is incremented: nodes, edges, profiles, open work and metrics are aggregates of the stored rows, so a stream that
is read again, or a batch that comes again, gives equal tables. Every aggregate is combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators.graph import MAX_DEPTH
from fernweave.operators.metrics import account_metrics
from fernweave.streaming import ingest


def edges(store: ingest.Store) -> DataFrame:
    """task_id, source_account_id, target_account_id, source_depth: the least depth at which the list was asked for."""
    listed = store.get("listed", ingest.EDGE_ROWS)
    return listed.groupBy("task_id", F.col("source").alias("source_account_id"), F.col("target").alias("target_account_id")).agg(F.min("depth").alias("source_depth"))


def profiles(store: ingest.Store) -> DataFrame:
    """The last profile of each account, by the time and the id of its page and its place on it."""
    told = store.get("profiles", ingest.PROFILES)
    rest = [c for c in ingest.columns(ingest.PROFILES) if c not in ("task_id", "account_id", "event_id", "at", "position")]
    last = told.groupBy("task_id", "account_id").agg(F.max_by(F.struct(*rest), F.struct("at", "event_id", "position")).alias("p"))
    return last.select("task_id", "account_id", "p.*")


def nodes(store: ingest.Store, max_depth: int = MAX_DEPTH, min_followers: int = 0) -> DataFrame:
    """task_id, account_id, first_depth, expansion_status, network_indegree, collected_following."""
    known = edges(store)
    seen = known.select("task_id", F.col("source_account_id").alias("account_id"), F.col("source_depth").alias("d"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    seen = seen.unionByName(known.select("task_id", F.col("target_account_id").alias("account_id"), (F.col("source_depth") + 1).alias("d"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    rows = seen.groupBy("task_id", "account_id").agg(F.min("d").alias("first_depth"), F.sum("in").alias("network_indegree"), F.sum("out").alias("collected_following"))
    rows = rows.join(profiles(store).select("task_id", "account_id", "followers_count"), ["task_id", "account_id"], "left")
    few = F.coalesce(F.col("followers_count") < min_followers, F.lit(False)) & (F.col("first_depth") > 0)
    status = F.when(F.col("first_depth") > max_depth, "boundary").when(F.col("collected_following") > 0, "expanding").when(few, "filtered").otherwise("queued")
    return rows.select("task_id", "account_id", "first_depth", status.alias("expansion_status"), "network_indegree", "collected_following")


def open_expansions(store: ingest.Store, max_depth: int = MAX_DEPTH, min_followers: int = 0) -> DataFrame:
    """Work items for the accounts whose lists are to be asked for next."""
    waiting = nodes(store, max_depth, min_followers).filter("expansion_status = 'queued'")
    return waiting.select("task_id", "account_id", F.lit("Following").alias("operation"), F.col("first_depth").alias("depth"), F.lit("pending").alias("status"))


def posts(store: ingest.Store) -> DataFrame:
    """The posts of accounts: of several versions of one the first, by the time and the id of its page."""
    told = store.get("posts", ingest.POSTS)
    keys = ["task_id", "account_id", "post_id"]
    rest = [c for c in ingest.columns(ingest.POSTS) if c not in (*keys, "event_id", "at")]
    return told.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("at", "event_id")).alias("p")).select(*keys, "p.*")


def metrics(store: ingest.Store) -> DataFrame:
    """The metrics of accounts from the posts that are stored, a post once however often its page came."""
    return account_metrics(posts(store), profiles(store))
