"""State of a layered collection: what keeps a layer open, how large the layers are, how complete their lists are.

Every count is one conditional aggregate over a table; tables are joined only after they have been aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.rules import PLATFORM_ENDED, SELF_ENDED
from fernweave.operators.listing import of_task

FOLLOWING = "Following"
#: What can hold a layer open, in the order in which it is told, and the count behind each.
HOLDS = {
    "frontier_pending": "pending",
    "frontier_running": "running",
    "frontier_retryable": "retryable",
    "requests_in_flight": "in_flight_requests",
    "pages_unpublished": "unpublished_pages",
    "pages_unparsed": "unparsed_pages",
}


def layer_states(frames: dict[str, DataFrame], as_of: str, parser_group: str, depths: DataFrame | None = None) -> DataFrame:
    """One row for each task and depth asked for (else the task's open layer): the six counts, closed, blocked_by.

    A request is in flight only while the claim behind it is alive at as_of; one that a dead worker left behind isn't.
    """
    asked = frames["crawl_tasks"].select("task_id", F.col("current_depth").alias("depth")) if depths is None else depths
    now, key = F.lit(as_of).cast("timestamp"), ["task_id", "depth"]
    frontier = frames["crawl_frontier"].filter(F.col("operation") == FOLLOWING)
    items = frontier.groupBy(*key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "retryable")])
    alive = frontier.filter((F.col("status") == "running") & (F.col("lease_expires_at") > now)).select("frontier_id", "depth")
    started = frames["request_attempts"].filter(F.col("outcome") == "started").select("task_id", "frontier_id")
    requests = started.join(alive, "frontier_id").groupBy(*key).agg(F.count(F.lit(1)).alias("in_flight_requests"))
    pages = frames["raw_page_outbox"].filter((F.col("operation") == FOLLOWING) & F.col("dead_lettered_at").isNull())
    unpublished = pages.filter(F.col("published_at").isNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("unpublished_pages"))
    done = frames["processed_events"].filter(F.col("group_id") == parser_group).select("task_id", "event_id")
    unparsed = pages.join(done, ["task_id", "event_id"], "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("unparsed_pages"))
    rows = asked
    for part in (items, requests, unpublished, unparsed):
        rows = rows.join(part, key, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in HOLDS.values()})
    blocked = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(name)) for name, c in HOLDS.items()]))
    return rows.withColumn("blocked_by", blocked).withColumn("closed", F.size("blocked_by") == 0).select(*key, *HOLDS.values(), "closed", "blocked_by")


def advanced(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """tasks with the next layer open where the current one is closed; one past the boundary at most."""
    closed = states.filter("closed").select("task_id", F.col("depth").alias("__depth"))
    moved = F.when(F.col("__depth") == F.col("current_depth"), F.least(F.col("current_depth") + 1, F.col("max_depth") + 1)).otherwise(F.col("current_depth"))
    return tasks.join(closed, "task_id", "left").withColumn("current_depth", moved).select(*tasks.columns)


def expansion_complete(frames: dict[str, DataFrame], as_of: str, parser_group: str) -> DataFrame:
    """(task_id, expansion_complete): past the last layer that is expanded, and that layer is closed."""
    tasks = frames["crawl_tasks"].select("task_id", "current_depth", "max_depth")
    last = layer_states(frames, as_of, parser_group, tasks.select("task_id", F.col("max_depth").alias("depth")))
    return tasks.join(last.select("task_id", "closed"), "task_id").select("task_id", ((F.col("current_depth") > F.col("max_depth")) & F.col("closed")).alias("expansion_complete"))


def layer_metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """Sizes of each layer that has nodes: edges by the depth they lead to, observations by the depth of their path."""
    key = ["task_id", "depth"]
    nodes = frames["account_nodes"].groupBy("task_id", F.col("first_depth").alias("depth")).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("is_l6_boundary").alias("boundary_nodes"),
        F.count_if(F.col("expansion_status") == "filtered").alias("filtered"),
        F.count_if(F.col("expansion_status") == "complete").alias("expansions_complete"),
    )
    edges = frames["follow_edges"].groupBy("task_id", F.col("target_depth").alias("depth")).agg(F.count(F.lit(1)).alias("edges"))
    seen = frames["account_observations"].groupBy(*key).agg(F.count(F.lit(1)).alias("observations"), F.count_if("is_collision").alias("collisions"))
    asked = frames["request_attempts"].filter(F.col("operation") == FOLLOWING).select("task_id", "frontier_id")
    asked = asked.join(frames["crawl_frontier"].select("frontier_id", "depth"), "frontier_id").groupBy(*key).agg(F.count(F.lit(1)).alias("requests"))
    rows = nodes
    for part in (edges, seen, asked):
        rows = rows.join(part, key, "left")
    filled = ["edges", "observations", "collisions", "requests"]
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in filled}).select(*key, "nodes", "boundary_nodes", "edges", "observations", "collisions", "filtered", "expansions_complete", "requests")


def coverage(nodes: DataFrame) -> DataFrame:
    """Collected against declared lists, for chains that the platform ended apart from those that we ended."""
    col = F.col
    complete = col("expansion_status") == "complete"
    by = lambda reasons: complete & col("termination_reason").isin(*reasons) & (col("declared_following") > 0)
    short: Column = col("collected_following") < col("declared_following")
    return nodes.groupBy("task_id").agg(
        F.count_if(complete).alias("expanded"),
        F.count_if(complete & col("declared_following").isNotNull()).alias("comparable"),
        F.count_if(by(PLATFORM_ENDED) & short).alias("truncated"),
        F.count_if(by(SELF_ENDED) & short).alias("scan_capped"),
        F.avg(F.when(by(PLATFORM_ENDED), col("collected_following") / col("declared_following"))).alias("mean_coverage_ratio"),
    )


def termination_histogram(nodes: DataFrame) -> DataFrame:
    ended = nodes.filter(F.col("expansion_status").isin("complete", "failed"))
    return ended.groupBy("task_id", F.coalesce("termination_reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def checkpoint_report(frames: dict[str, DataFrame], task_id: str) -> DataFrame:
    """What the first layer looks like before more is spent: overlap of seeds, spread of followers, openness."""
    nodes = of_task(frames["account_nodes"], task_id).filter("first_depth = 1").select("account_id")
    trees = of_task(frames["account_observations"], task_id).groupBy("account_id").agg(F.countDistinct("tree_id").alias("trees"))
    profiles = of_task(frames["account_profiles"], task_id).select("account_id", "followers_count", "following_count", "can_dm")
    rows = nodes.join(trees, "account_id", "left").join(profiles, "account_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("trees") > 1).alias("shared_by_seeds"),
        F.percentile("followers_count", 0.5).alias("median_followers"),
        F.percentile("following_count", 0.5).alias("median_following"),
        F.avg(F.col("can_dm").cast("int")).alias("can_dm_share"),
    )
