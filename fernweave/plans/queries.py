"""The library's queries over the driver's tables, and the same results in SQL that DuckDB reads.

A query is an operator applied to the model that sources.adapters derives from the tables. Lists are joined with | in the
results, moments are told as text and doubles are rounded to six digits, so that both engines' values can be compared.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernweave.common import cut, stored
from fernweave.functions import rules
from fernweave.operators import admission, chains, feeds, graph, layers, listing, metrics, outreach, parse, pool, records, tasks
from fernweave.plans import export
from fernweave.sources import seeds
from fernweave.sources.adapters import AS_OF, TASK, duckdb_with, frame, frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEEDS = ("0", "1")
CORE = ("account_nodes", "account_profiles", "account_posts", "root_trees", "account_observations", "follow_edges", "follow_edge_observations")


def query(sql: str | None = None, **more: str) -> Callable[[Query], Query]:
    """Register a query, with its SQL over the model's tables (in braces) if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duckdb_with(sql, **more)
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """df with lists joined, moments as text and doubles rounded."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(c, "|")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            c = F.round(c, 6)
        out.append(c.alias(name))
    return df.select(*out)


def model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph's tables, with the metrics that the posts give."""
    found = frames(spark, sf_dir, *CORE)
    found["account_nodes"] = found["account_nodes"].withColumn("candidate_reasons", F.lit(None).cast("array<string>"))
    found["account_profiles"] = found["account_profiles"].withColumns({"created_at": F.lit(None).cast("timestamp"), "observed_at": F.lit(None).cast("timestamp")})
    return found | {"account_metrics": metrics.account_metrics(found["account_posts"], found["account_profiles"])}


METRICS = """
    SELECT s.task_id, s.account_id, coalesce(m.sample_count, 0) AS sample_count, s.scanned_count, m.sample_span_days, m.latest_post_at, m.avg_reply, m.avg_retweet,
           m.avg_like, m.avg_view, coalesce(m.view_sample_count, 0) AS view_sample_count, m.median_engagement, m.engagement_rate,
           m.avg_view / nullif(p.followers_count, 0) AS reach_ratio, m.bookmark_rate
    FROM (SELECT task_id, account_id, count(*) AS scanned_count FROM {account_posts} GROUP BY ALL) s
    LEFT JOIN (
        SELECT account_id, count(*) AS sample_count, epoch_us(max(posted_at)) / 86400000000.0 - epoch_us(min(posted_at)) / 86400000000.0 AS sample_span_days,
               max(posted_at) AS latest_post_at, avg(reply_count) AS avg_reply, avg(retweet_count) AS avg_retweet, avg(like_count) AS avg_like, avg(view_count) AS avg_view,
               count(view_count) AS view_sample_count, quantile_cont(reply_count + retweet_count + like_count, 0.5) AS median_engagement,
               sum(CASE WHEN view_count IS NOT NULL THEN reply_count + retweet_count + like_count END) / nullif(sum(view_count), 0) AS engagement_rate,
               sum(CASE WHEN view_count IS NOT NULL THEN bookmark_count END) / nullif(sum(view_count), 0) AS bookmark_rate
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY posted_at DESC NULLS LAST, post_id) AS k FROM {account_posts} WHERE is_qualifying) r
        WHERE k <= 30 GROUP BY account_id) m ON m.account_id = s.account_id
    LEFT JOIN {account_profiles} p ON p.account_id = s.account_id"""

LISTED = """
    SELECT n.*, p.* EXCLUDE (task_id, account_id), m.* EXCLUDE (task_id, account_id), m.account_id IS NOT NULL AS has_metrics, coalesce(o.tree_count, 0) AS tree_count,
           coalesce(o.observation_count, 0) AS observation_count, coalesce(o.collision_count, 0) AS collision_count, coalesce(o.trees, '') AS trees, t.tree_id AS seed_of_tree,
           CASE WHEN declared_following <> 0 THEN round(collected_following / declared_following, 4) END AS coverage_ratio,
           array_to_string(list_filter([
               CASE WHEN is_l6_boundary THEN 'boundary_not_expanded' END, CASE WHEN expansion_status = 'failed' THEN 'expansion_failed' END,
               CASE WHEN expansion_status = 'filtered' THEN 'expansion_filtered' END,
               CASE WHEN declared_following <> 0 AND collected_following < declared_following
                    THEN CASE WHEN termination_reason IN ('page_limit', 'budget_exhausted') THEN 'scan_capped' ELSE 'following_truncated' END END,
               CASE WHEN o.collision_count > 0 THEN 'multiple_discovery_paths' END, CASE WHEN sample_count IS NOT NULL AND view_sample_count = 0 THEN 'no_view_counts_in_sample' END
           ], lambda x: x IS NOT NULL), '|') AS warnings
    FROM {account_nodes} n LEFT JOIN {account_profiles} p ON p.account_id = n.account_id LEFT JOIN {metrics} m ON m.account_id = n.account_id
    LEFT JOIN (SELECT account_id, count(DISTINCT tree_id) AS tree_count, count(*) AS observation_count, count(*) FILTER (is_collision) AS collision_count,
                      array_to_string(list_sort(list(DISTINCT tree_id)), '|') AS trees FROM {account_observations} GROUP BY account_id) o ON o.account_id = n.account_id
    LEFT JOIN {root_trees} t ON t.seed_account_id = n.account_id"""
SHOWN = ["account_id", "first_depth", "expansion_status", "network_indegree", "username", "followers_count", "can_dm", "verified", "protected", "tree_count", "observation_count", "collision_count", "trees", "seed_of_tree", "sample_count", "median_engagement", "coverage_ratio", "warnings"]
_SHOWN_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in ("median_engagement", "coverage_ratio") else c for c in SHOWN)


@query("SELECT target_account_id AS account_id, count(*) AS n FROM {follow_edges} GROUP BY 1 ORDER BY n DESC, account_id LIMIT 100")
def indegree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.indegree(frame(spark, sf_dir, "follow_edges")).orderBy(F.col("n").desc(), "account_id").limit(100)


def _listing(spark: SparkSession, sf_dir: str, wanted: listing.AccountFilter) -> DataFrame:
    return _plain(listing.account_page(model(spark, sf_dir), TASK, wanted).select(*SHOWN))


@query(f"SELECT {_SHOWN_SQL} FROM {{listed}} WHERE followers_count >= 0 AND network_indegree >= 2 ORDER BY followers_count DESC NULLS LAST, account_id LIMIT 200", listed=LISTED, metrics=METRICS)
def account_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir, listing.AccountFilter(min_followers=0, min_network_indegree=2, order_by="followers", limit=200))


@query(f"SELECT {_SHOWN_SQL} FROM {{listed}} WHERE (username ILIKE '%BUILD%' OR display_name ILIKE '%BUILD%' OR description ILIKE '%BUILD%' OR account_id = 'BUILD') AND trees LIKE '%tree-a%' AND coalesce(verified, false) = false AND can_dm = true AND coalesce(protected, false) = false ORDER BY first_depth ASC NULLS LAST, account_id LIMIT 300 OFFSET 3", listed=LISTED, metrics=METRICS)
def account_listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = listing.AccountFilter(search="BUILD", tree_ids=("tree-a",), verified=False, can_dm=True, protected=False, order_by="depth", descending=False, limit=300, offset=3)
    return _listing(spark, sf_dir, wanted)


@query(f"SELECT {_SHOWN_SQL} FROM {{listed}} WHERE (expansion_status IN ('failed', 'filtered') OR (declared_following > 0 AND collected_following < declared_following)) AND has_metrics AND collision_count > 0 AND first_depth IN (0, 1, 2, 3) AND followers_count <= 9000 ORDER BY median_engagement DESC NULLS LAST, account_id LIMIT 500", listed=LISTED, metrics=METRICS)
def account_listing_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = listing.AccountFilter(incomplete_only=True, has_timeline=True, collisions_only=True, depths=(0, 1, 2, 3), max_followers=9000, order_by="median_engagement", limit=500)
    return _listing(spark, sf_dir, wanted)


@query(f"SELECT {_SHOWN_SQL} FROM {{listed}} WHERE is_l6_boundary OR seed_of_tree IS NOT NULL ORDER BY account_id", listed=LISTED, metrics=METRICS)
def account_listing_boundary_and_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model(spark, sf_dir)
    rows = [listing.account_rows(found, TASK, listing.AccountFilter(**{flag: True})) for flag in ("boundary_only", "seeds_only")]
    return _plain(rows[0].unionByName(rows[1]).select(*SHOWN).distinct().orderBy("account_id"))


@query("SELECT count(*) AS total FROM {listed} WHERE incomplete", listed="SELECT expansion_status IN ('failed', 'filtered') OR (declared_following > 0 AND collected_following < declared_following) AS incomplete FROM {account_nodes}")
def account_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.account_total(model(spark, sf_dir), TASK, listing.AccountFilter(incomplete_only=True))


@query("SELECT account_id FROM {account_nodes} ORDER BY network_indegree DESC, account_id LIMIT 250")
def account_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.account_ids(model(spark, sf_dir), TASK, listing.AccountFilter(), cap=250)


@query(f"SELECT {_SHOWN_SQL} FROM {{listed}} WHERE account_id = '12'", listed=LISTED, metrics=METRICS)
def account_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(listing.account_detail(model(spark, sf_dir), TASK, "12")["account"].select(*SHOWN))


@query("SELECT tree_id, parent_account_id, depth, is_collision FROM {account_observations} WHERE account_id = '12' ORDER BY depth, observed_at, tree_id, parent_account_id LIMIT 50")
def account_detail_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.discovery_paths(model(spark, sf_dir), TASK, "12").drop("observed_at")


@query("SELECT target_account_id, target_depth, is_l6_boundary, username, followers_count, can_dm FROM {follow_edges} e LEFT JOIN {account_profiles} p ON p.account_id = e.target_account_id WHERE source_account_id = '12' ORDER BY followers_count DESC NULLS LAST, target_account_id LIMIT 100")
def account_detail_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.following(model(spark, sf_dir), TASK, "12")


@query("SELECT source_account_id, source_depth, username, followers_count FROM {follow_edges} e LEFT JOIN {account_profiles} p ON p.account_id = e.source_account_id WHERE target_account_id = '12' ORDER BY followers_count DESC NULLS LAST, source_account_id LIMIT 100")
def account_detail_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.followed_by(model(spark, sf_dir), TASK, "12")


@query("SELECT post_id, kind, is_qualifying, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, reply_count, retweet_count, like_count, quote_count, bookmark_count, view_count FROM {account_posts} p WHERE account_id = '12' AND is_qualifying ORDER BY p.posted_at DESC NULLS LAST, post_id LIMIT 30")
def account_detail_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(listing.qualifying_posts(model(spark, sf_dir), TASK, "12").drop("text"))


EDGES = """
    SELECT e.source_account_id, e.target_account_id, e.source_depth, e.target_depth, e.is_l6_boundary, coalesce(o.trees, '') AS trees, coalesce(o.is_collision, false) AS is_collision
    FROM {follow_edges} e LEFT JOIN (SELECT source_account_id, target_account_id, array_to_string(list_sort(list(DISTINCT tree_id)), '|') AS trees, bool_or(is_collision) AS is_collision
                                     FROM {follow_edge_observations} GROUP BY ALL) o ON o.source_account_id = e.source_account_id AND o.target_account_id = e.target_account_id"""


@query("SELECT * FROM {edges} WHERE trees LIKE '%tree-b%' AND is_collision AND target_depth IN (2, 3, 6) ORDER BY source_account_id, target_account_id LIMIT 500 OFFSET 5", edges=EDGES)
def relationships_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = listing.EdgeFilter(tree_ids=("tree-b",), collisions_only=True, depths=(2, 3, 6), limit=500, offset=5)
    return _plain(listing.relationship_page(model(spark, sf_dir), TASK, wanted).drop("first_seen_at"))


@query("SELECT * FROM {edges} WHERE is_l6_boundary", edges=EDGES)
def relationships_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(listing.relationship_rows(model(spark, sf_dir), TASK, listing.EdgeFilter(boundary_only=True)).drop("first_seen_at"))


MIN_FOLLOWERS = 500
LISTS = "SELECT e.source_account_id AS source, e.target_account_id AS target, p.followers_count AS followers FROM {follow_edges} e LEFT JOIN {account_profiles} p ON p.account_id = e.target_account_id"
# An account is expanded unless it has too few followers; seeds always are. UNION keeps (account, depth) pairs apart.
REACH = f"""
    SELECT CAST(x AS STRING) AS account_id, 0 AS depth FROM (VALUES (0), (1)) v(x)
    UNION SELECT l.target, r.depth + 1 FROM {{reach}} r JOIN {{lists}} l ON l.source = r.account_id LEFT JOIN {{few}} f ON f.account_id = r.account_id
    WHERE r.depth < 6 AND (r.depth = 0 OR f.account_id IS NULL)"""
FEW = f"SELECT account_id FROM {{account_profiles}} WHERE followers_count < {MIN_FOLLOWERS}"
# The least depth of an account at which it was reached; a seed with few followers is reached again at its own depth only.
DEPTHS = "SELECT account_id, CAST(min(depth) AS INT) AS first_depth FROM {reach} GROUP BY account_id"
EXPANDED = "SELECT d.account_id, d.first_depth FROM {depths} d LEFT JOIN {few} f ON f.account_id = d.account_id WHERE d.first_depth <= 5 AND (d.first_depth = 0 OR f.account_id IS NULL)"
BUILT = "SELECT l.source AS source_account_id, l.target AS target_account_id, x.first_depth AS source_depth, d.first_depth AS target_depth, d.first_depth > 5 AS is_l6_boundary FROM {lists} l JOIN {expanded} x ON x.account_id = l.source JOIN {depths} d ON d.account_id = l.target"
_BFS = {"lists": LISTS, "reach": REACH, "few": FEW, "depths": DEPTHS, "expanded": EXPANDED, "built": BUILT}


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all accounts' lists, and the seeds."""
    found = frames(spark, sf_dir, "follow_edges", "account_profiles")
    followers = found["account_profiles"].select(F.col("account_id").alias("target"), F.col("followers_count").alias("followers"))
    rows = found["follow_edges"].select(F.col("source_account_id").alias("source"), F.col("target_account_id").alias("target")).join(followers, "target", "left")
    rows = rows.select("source", F.lit(1).alias("page_no"), F.col("target").cast("bigint").alias("position"), "target", "followers")
    return rows, spark.createDataFrame([("tree-a", "0"), ("tree-b", "1")], "tree_id string, account_id string")


def _built(spark: SparkSession, sf_dir: str) -> graph.Graph:
    rows, starts = _lists(spark, sf_dir)
    return graph.build(starts, rows, min_followers=MIN_FOLLOWERS)


_BFS_NODES_SQL = (
    "SELECT d.account_id, d.first_depth, d.first_depth > 5 AS is_l6_boundary, CASE WHEN d.first_depth > 5 THEN 'boundary' WHEN d.first_depth > 0 AND f.account_id IS NOT NULL THEN 'filtered' ELSE 'pending' END AS expansion_status, coalesce(i.n, 0) AS network_indegree, coalesce(o.n, 0) AS collected_following FROM {depths} d LEFT JOIN {few} f ON f.account_id = d.account_id LEFT JOIN (SELECT target_account_id AS id, count(*) AS n FROM {built} GROUP BY 1) i ON i.id = d.account_id LEFT JOIN (SELECT source_account_id AS id, count(*) AS n FROM {built} GROUP BY 1) o ON o.id = d.account_id"
)


@query(_BFS_NODES_SQL, **_BFS)
def bfs_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).nodes.drop("tree_id", "filter_reason")


@query("SELECT * FROM {built}", **_BFS)
def bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).edges


ROOTED = "SELECT account_id, tree FROM (VALUES ('0', 'tree-a'), ('1', 'tree-b')) v(account_id, tree) UNION SELECT b.target_account_id, r.tree FROM {rooted} r JOIN {built} b ON b.source_account_id = r.account_id WHERE b.target_depth = b.source_depth + 1"


@query(
    "SELECT t.tree AS tree_id, b.target_account_id AS account_id, b.source_account_id AS parent_account_id, b.source_depth + 1 AS depth, NOT (b.target_depth = b.source_depth + 1 AND row_number() OVER (PARTITION BY b.target_account_id, b.target_depth = b.source_depth + 1 ORDER BY t.tree, b.source_account_id) = 1) AS is_collision FROM {built} b JOIN (SELECT account_id, min(tree) AS tree FROM {rooted} GROUP BY 1) t ON t.account_id = b.source_account_id",
    **_BFS,
    rooted=ROOTED,
)
def bfs_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).observations


NEAR = "SELECT CAST(x AS STRING) AS account_id, 0 AS hop FROM (VALUES (0), (1)) v(x) UNION SELECT e.target_account_id, r.hop + 1 FROM {near} r JOIN {follow_edges} e ON e.source_account_id = r.account_id WHERE r.hop < 3"
SUB_NODES = "SELECT n.account_id, n.first_depth, n.is_l6_boundary, n.expansion_status, n.timeline_status, p.username, p.followers_count, p.can_dm, coalesce(i.n, 0) AS network_indegree, t.tree_id IS NOT NULL AS is_seed FROM {account_nodes} n LEFT JOIN {account_profiles} p ON p.account_id = n.account_id LEFT JOIN {root_trees} t ON t.seed_account_id = n.account_id LEFT JOIN (SELECT target_account_id AS id, count(*) AS n FROM {follow_edges} GROUP BY 1) i ON i.id = n.account_id WHERE n.account_id IN (SELECT account_id FROM {near}) ORDER BY network_indegree DESC, n.account_id LIMIT 60"


@query("SELECT * FROM {sub_nodes}", near=NEAR, sub_nodes=SUB_NODES)
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(model(spark, sf_dir), TASK, seeds=SEEDS, hops=3, node_limit=60).nodes


@query("SELECT source_account_id, target_account_id, source_depth, target_depth, is_l6_boundary FROM {follow_edges} WHERE source_account_id IN (SELECT account_id FROM {sub_nodes}) AND target_account_id IN (SELECT account_id FROM {sub_nodes}) ORDER BY 1, 2 LIMIT 5000", near=NEAR, sub_nodes=SUB_NODES)
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(model(spark, sf_dir), TASK, seeds=SEEDS, hops=3, node_limit=60).edges


@query("SELECT task_id, account_id, sample_count, scanned_count, round(sample_span_days, 6) AS sample_span_days, strftime(latest_post_at, '%Y-%m-%d %H:%M:%S') AS latest_post_at, round(avg_reply, 6) AS avg_reply, round(avg_retweet, 6) AS avg_retweet, round(avg_like, 6) AS avg_like, round(avg_view, 6) AS avg_view, view_sample_count, round(median_engagement, 6) AS median_engagement, round(engagement_rate, 6) AS engagement_rate, round(reach_ratio, 6) AS reach_ratio, round(bookmark_rate, 6) AS bookmark_rate FROM {metrics}", metrics=METRICS)
def post_sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "account_posts", "account_profiles")
    return _plain(metrics.account_metrics(found["account_posts"], found["account_profiles"]))


@query("SELECT account_id, sample_count, scanned_count FROM {metrics} WHERE account_id = '12'", metrics=METRICS)
def metrics_of_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_of(model(spark, sf_dir)["account_metrics"], TASK, "12").select("account_id", "sample_count", "scanned_count")


@query("SELECT task_id, account_id, count(*) FILTER (is_qualifying) AS qualifying, count(*) AS scanned FROM {account_posts} GROUP BY ALL")
def qualifying_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.qualifying_progress(frame(spark, sf_dir, "account_posts"))


POLICY = admission.CandidatePolicy(require_can_dm=True, min_followers=100, max_followers=9500, min_network_indegree=3, min_discovery_paths=2, bio_keywords=("build", "auto_"), max_depth=4, limit=400)
ELIGIBLE = "SELECT n.account_id, coalesce(i.n, 0) AS network_indegree, p.followers_count, 'can_dm|not_protected|follower_range|network_indegree|discovery_paths|bio_keyword|depth' AS candidate_reasons FROM {account_nodes} n JOIN {account_profiles} p ON p.account_id = n.account_id LEFT JOIN (SELECT target_account_id AS id, count(*) AS n FROM {follow_edges} GROUP BY 1) i ON i.id = n.account_id LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM {account_observations} GROUP BY 1) o ON o.id = n.account_id WHERE timeline_status = 'none' AND can_dm AND NOT coalesce(protected, false) AND followers_count BETWEEN 100 AND 9500 AND coalesce(i.n, 0) >= 3 AND coalesce(o.n, 0) >= 2 AND first_depth <= 4 AND len(list_filter(['build', 'auto_'], lambda k: description ILIKE '%' || k || '%')) > 0 ORDER BY network_indegree DESC, followers_count DESC NULLS LAST, n.account_id LIMIT 400"


@query("SELECT * FROM {eligible}", eligible=ELIGIBLE)
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model(spark, sf_dir) | frames(spark, sf_dir, "crawl_tasks")
    return _plain(admission.candidates(found, TASK, POLICY))


@query("SELECT CASE WHEN e.account_id IS NULL THEN n.timeline_status ELSE 'queued' END AS timeline_status, coalesce(e.candidate_reasons, '') AS candidate_reasons, count(*) AS n FROM {account_nodes} n LEFT JOIN {eligible} e ON e.account_id = n.account_id GROUP BY ALL", eligible=ELIGIBLE)
def nodes_after_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model(spark, sf_dir)
    nodes = admission.admitted(found["account_nodes"], admission.eligible(found, TASK, POLICY), TASK)
    return nodes.groupBy("timeline_status", F.coalesce(F.array_join("candidate_reasons", "|"), F.lit("")).alias("candidate_reasons")).agg(F.count(F.lit(1)).alias("n"))


VOTED = "SELECT v.target_account_id AS account_id, count(*) AS network_indegree FROM {votes} v GROUP BY 1"
TOP = "SELECT account_id FROM {voted} ORDER BY network_indegree DESC, account_id LIMIT 1"


def votes_model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The bipartite graph of who buys from whom: voters and candidates, with in-degrees and profiles."""
    edges = stored(frame(spark, sf_dir, "votes"), "votes")  # a join and a distinct, which all that follows would do again
    degree = graph.indegree(edges).withColumnRenamed("n", "network_indegree").withColumn("task_id", F.lit(TASK))
    voters = edges.select("task_id", F.col("source_account_id").alias("account_id")).distinct().withColumn("network_indegree", F.lit(0).cast("bigint"))
    number = F.substring("account_id", 2, 20).cast("bigint")
    everyone = stored(degree.select("task_id", "account_id", "network_indegree").unionByName(voters.select("task_id", "account_id", "network_indegree")), "nodes")
    profiles = everyone.select("task_id", "account_id", F.concat(F.lit("u"), "account_id").alias("username"), (number * 37 % 1000).cast("int").alias("followers_count"), (number % 3 != 0).alias("can_dm"), F.when(number % 5 != 0, number % 7 == 0).alias("protected"))
    return {"follow_edges": edges, "account_nodes": everyone, "account_profiles": profiles}


@query(
    "SELECT p.account_id, concat('u', p.account_id) AS username, p.shared AS shared_voters, round(n.network_indegree * mine / total, 2) AS expected_shared, round(p.shared / (n.network_indegree * mine / total), 2) AS lift, round((p.shared - n.network_indegree * mine / total) / nullif(sqrt(n.network_indegree * (mine / total * (1 - mine / total))), 0), 2) AS excess_sigma, CAST(CAST(substr(p.account_id, 2) AS BIGINT) * 37 % 1000 AS INT) AS followers_count, CAST(substr(p.account_id, 2) AS BIGINT) % 3 <> 0 AS can_dm FROM {shared} p JOIN {voted} n ON n.account_id = p.account_id, {scale} WHERE mine > 0 AND mine < total ORDER BY (p.shared - n.network_indegree * mine / total) / nullif(sqrt(n.network_indegree * (mine / total * (1 - mine / total))), 0) DESC NULLS LAST, p.shared DESC, p.account_id LIMIT 50",
    voted=VOTED,
    top=TOP,
    shared="SELECT v.target_account_id AS account_id, count(*) AS shared FROM {votes} v JOIN {votes} w ON w.source_account_id = v.source_account_id AND w.target_account_id = (SELECT account_id FROM {top}) WHERE v.target_account_id <> w.target_account_id GROUP BY 1 HAVING count(*) >= 8",
    scale="SELECT CAST(count(DISTINCT source_account_id) AS DOUBLE) AS total, count(*) FILTER (target_account_id = (SELECT account_id FROM {top})) AS mine FROM {votes}",
)
def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes_model(spark, sf_dir)
    return outreach.affinity(found, TASK, _top(found), limit=50)


def _top(found: dict[str, DataFrame]) -> str:
    return found["account_nodes"].orderBy(F.col("network_indegree").desc(), "account_id").select("account_id").head()[0]


_OPEN = "(CAST(substr(source_account_id, 2) AS BIGINT) % 3 <> 0) AND (CASE WHEN CAST(substr(source_account_id, 2) AS BIGINT) % 5 = 0 THEN true ELSE CAST(substr(source_account_id, 2) AS BIGINT) % 7 <> 0 END)"


@query(f"SELECT source_account_id AS account_id, concat('u', source_account_id) AS username, CAST(CAST(substr(source_account_id, 2) AS BIGINT) * 37 % 1000 AS INT) AS followers_count, CAST(0 AS BIGINT) AS network_indegree FROM {{votes}} WHERE target_account_id = (SELECT account_id FROM {{top}}) AND {_OPEN} ORDER BY followers_count DESC NULLS LAST, account_id LIMIT 100", voted=VOTED, top=TOP)
def introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes_model(spark, sf_dir)
    return outreach.introductions(found, TASK, _top(found))


@query(f"SELECT count(*) AS total FROM {{votes}} WHERE target_account_id = (SELECT account_id FROM {{top}}) AND {_OPEN}", voted=VOTED, top=TOP)
def introductions_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes_model(spark, sf_dir)
    return outreach.introductions_total(found, TASK, _top(found))


#: Picks of the plan.
PICKS = 20


def _greedy_sql(picks: int) -> dict[str, str]:
    """Greedy cover spelled out pick by pick: each takes the account with the most voters that earlier picks lack."""
    parts = {"pick0": "SELECT CAST(NULL AS STRING) AS account_id, CAST(0 AS BIGINT) AS gain WHERE false", "done0": "SELECT source_account_id AS v FROM {votes} WHERE false"}
    for k in range(1, picks + 1):
        parts[f"pick{k}"] = f"SELECT v.target_account_id AS account_id, count(*) AS gain FROM {{votes}} v JOIN {{voted}} n ON n.account_id = v.target_account_id WHERE v.source_account_id NOT IN (SELECT v FROM {{done{k - 1}}}) GROUP BY v.target_account_id, n.network_indegree ORDER BY gain DESC, n.network_indegree DESC, v.target_account_id LIMIT 1"
        parts[f"done{k}"] = f"SELECT v FROM {{done{k - 1}}} UNION ALL SELECT source_account_id FROM {{votes}} WHERE target_account_id = (SELECT account_id FROM {{pick{k}}})"
    return parts


@query(
    "SELECT CAST(k AS INT) AS place, p.account_id, gain AS new_reach, CAST(sum(gain) OVER (ORDER BY k) AS BIGINT) AS cumulative_reach, round(sum(gain) OVER (ORDER BY k) / (SELECT count(DISTINCT source_account_id) FROM {votes}), 4) AS coverage_share, n.network_indegree AS voters FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS k, * FROM {{pick{k}}}" for k in range(1, PICKS + 1))
    + ") p JOIN {voted} n ON n.account_id = p.account_id",
    voted=VOTED,
    **_greedy_sql(PICKS),
)
def approach_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = votes_model(spark, sf_dir)
    plan = outreach.approach_plan(found, TASK, found["account_nodes"].filter("network_indegree > 0"), picks=PICKS, max_pool=None)
    rows = [(k, s["account_id"], s["new_reach"], s["cumulative_reach"], s["coverage_share"], s["voters"]) for k, s in enumerate(plan.steps, 1)]
    return spark.createDataFrame(rows, "place int, account_id string, new_reach bigint, cumulative_reach bigint, coverage_share double, voters bigint")


@query("SELECT target_account_id AS account_id FROM {votes} WHERE source_account_id IN ('c3', 'c4', 'c6') GROUP BY 1 HAVING count(DISTINCT source_account_id) = 3")
def common_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outreach.common_follows(votes_model(spark, sf_dir), TASK, ["c3", "c4", "c6"])


_PLATFORM, _SELF = "termination_reason IN ('natural_end', 'empty_pages', 'cursor_stalled')", "termination_reason IN ('page_limit', 'budget_exhausted')"


@query(f"SELECT task_id, count(*) FILTER (expansion_status = 'complete') AS expanded, count(*) FILTER (expansion_status = 'complete' AND declared_following IS NOT NULL) AS comparable, count(*) FILTER (expansion_status = 'complete' AND {_PLATFORM} AND declared_following > 0 AND collected_following < declared_following) AS truncated, count(*) FILTER (expansion_status = 'complete' AND {_SELF} AND declared_following > 0 AND collected_following < declared_following) AS scan_capped, round(avg(collected_following / declared_following) FILTER (expansion_status = 'complete' AND {_PLATFORM} AND declared_following > 0), 6) AS mean_coverage_ratio FROM {{account_nodes}} GROUP BY task_id")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(layers.coverage(frame(spark, sf_dir, "account_nodes")))


@query("SELECT task_id, coalesce(termination_reason, 'unknown') AS reason, count(*) AS n FROM {account_nodes} WHERE expansion_status IN ('complete', 'failed') GROUP BY ALL")
def termination_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.termination_histogram(frame(spark, sf_dir, "account_nodes"))


WORK = ("crawl_tasks", "crawl_frontier", "request_attempts", "raw_page_outbox", "processed_events")
_COUNTS = "(SELECT count(*) FROM {crawl_frontier} f WHERE f.task_id = t.task_id AND f.depth = t.depth AND operation = 'Following' AND status = '%s')"
STATES = f"""
    SELECT task_id, depth, {_COUNTS % "pending"} AS pending, {_COUNTS % "running"} AS running, {_COUNTS % "retryable"} AS retryable,
           (SELECT count(*) FROM {{request_attempts}} a JOIN {{crawl_frontier}} f ON f.frontier_id = a.frontier_id WHERE a.task_id = t.task_id AND f.depth = t.depth AND f.operation = 'Following'
             AND a.outcome = 'started' AND f.status = 'running' AND f.lease_expires_at > CAST('{AS_OF}' AS TIMESTAMP)) AS in_flight_requests,
           (SELECT count(*) FROM {{raw_page_outbox}} o WHERE o.task_id = t.task_id AND o.depth = t.depth AND operation = 'Following' AND published_at IS NULL AND dead_lettered_at IS NULL) AS unpublished_pages,
           (SELECT count(*) FROM {{raw_page_outbox}} o LEFT JOIN {{processed_events}} p ON p.task_id = o.task_id AND p.event_id = o.event_id
             WHERE o.task_id = t.task_id AND o.depth = t.depth AND operation = 'Following' AND dead_lettered_at IS NULL AND p.event_id IS NULL) AS unparsed_pages
    FROM {{asked}} t"""
_CLOSED = "pending + running + retryable + in_flight_requests + unpublished_pages + unparsed_pages = 0"
_OF_TASKS = {"asked": "SELECT task_id, current_depth AS depth FROM {crawl_tasks}", "states": STATES}


@query(
    f"SELECT *, {_CLOSED} AS closed, array_to_string(list_filter([CASE WHEN pending > 0 THEN 'frontier_pending' END, CASE WHEN running > 0 THEN 'frontier_running' END, CASE WHEN retryable > 0 THEN 'frontier_retryable' END, CASE WHEN in_flight_requests > 0 THEN 'requests_in_flight' END, CASE WHEN unpublished_pages > 0 THEN 'pages_unpublished' END, CASE WHEN unparsed_pages > 0 THEN 'pages_unparsed' END], lambda x: x IS NOT NULL), '|') AS blocked_by FROM {{states}}",
    **_OF_TASKS,
)
def layer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(layers.layer_states(frames(spark, sf_dir, *WORK), AS_OF, "parser"))


@query(f"SELECT t.task_id, CAST(CASE WHEN {_CLOSED} THEN least(t.current_depth + 1, t.max_depth + 1) ELSE t.current_depth END AS INT) AS current_depth FROM {{crawl_tasks}} t JOIN {{states}} s ON s.task_id = t.task_id", **_OF_TASKS)
def advance_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, *WORK)
    return layers.advanced(found["crawl_tasks"], layers.layer_states(found, AS_OF, "parser")).select("task_id", "current_depth")


@query(f"SELECT t.task_id, t.current_depth > t.max_depth AND {_CLOSED} AS expansion_complete FROM {{crawl_tasks}} t JOIN {{states}} s ON s.task_id = t.task_id", asked="SELECT task_id, max_depth AS depth FROM {crawl_tasks}", states=STATES)
def expansion_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.expansion_complete(frames(spark, sf_dir, *WORK), AS_OF, "parser")


@query("SELECT n.*, (SELECT count(*) FROM {follow_edges} e WHERE e.target_depth = n.depth) AS edges, (SELECT count(*) FROM {account_observations} o WHERE o.depth = n.depth) AS observations, (SELECT count(*) FROM {account_observations} o WHERE o.depth = n.depth AND is_collision) AS collisions, (SELECT count(*) FROM {request_attempts} a JOIN {crawl_frontier} f ON f.frontier_id = a.frontier_id WHERE a.task_id = n.task_id AND f.depth = n.depth AND a.operation = 'Following') AS requests FROM (SELECT task_id, first_depth AS depth, count(*) AS nodes, count(*) FILTER (is_l6_boundary) AS boundary_nodes, count(*) FILTER (expansion_status = 'filtered') AS filtered, count(*) FILTER (expansion_status = 'complete') AS expansions_complete FROM {account_nodes} GROUP BY ALL) n")
def layer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_metrics(frames(spark, sf_dir, "account_nodes", "follow_edges", "account_observations", "request_attempts", "crawl_frontier"))


@query("SELECT count(*) AS accounts, count(*) FILTER (o.trees > 1) AS shared_by_seeds, round(quantile_cont(followers_count, 0.5), 6) AS median_followers, round(quantile_cont(following_count, 0.5), 6) AS median_following, round(avg(CAST(can_dm AS INT)), 6) AS can_dm_share FROM {account_nodes} n LEFT JOIN (SELECT account_id, count(DISTINCT tree_id) AS trees FROM {account_observations} GROUP BY 1) o ON o.account_id = n.account_id LEFT JOIN {account_profiles} p ON p.account_id = n.account_id WHERE first_depth = 1")
def checkpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(layers.checkpoint_report(model(spark, sf_dir), TASK))


@query("SELECT t.task_id, status, current_depth, max_depth, timeline_enabled, requests_attempted, max_requests, nodes_created, edges_created, pages_produced, pages_processed, strftime(t.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(n, 0) AS seeds FROM {crawl_tasks} t LEFT JOIN (SELECT task_id, count(*) AS n FROM {root_trees} GROUP BY 1) r ON r.task_id = t.task_id ORDER BY t.created_at DESC, t.task_id LIMIT 50")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "crawl_tasks", "root_trees")
    return _plain(tasks.task_list(found["crawl_tasks"].withColumn("updated_at", F.col("created_at")), found["root_trees"]).drop("updated_at"))


@query("SELECT task_id, operation, status, count(*) AS n FROM {crawl_frontier} GROUP BY ALL")
def frontier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.frontier_counts(frame(spark, sf_dir, "crawl_frontier"))


@query("SELECT last_error_class AS error_class, count(*) AS n FROM {crawl_frontier} WHERE task_id = 't1' AND last_error_class IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.top_errors(frame(spark, sf_dir, "crawl_frontier"), TASK)


@query(f"SELECT task_id, count(*) AS n, strftime(min(not_before), '%Y-%m-%d %H:%M:%S') AS earliest FROM {{crawl_frontier}} WHERE status = 'retryable' AND not_before > CAST('{AS_OF}' AS TIMESTAMP) GROUP BY 1")
def rate_limit_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tasks.rate_limit_wait(frame(spark, sf_dir, "crawl_frontier"), AS_OF))


@query(f"SELECT frontier_id, task_id, operation, depth, priority, attempt FROM (SELECT f.* FROM {{crawl_frontier}} f JOIN {{crawl_tasks}} t ON t.task_id = f.task_id WHERE t.status = 'running' AND (operation <> 'Following' OR depth = current_depth) AND (f.status IN ('pending', 'retryable') OR (f.status = 'running' AND lease_expires_at <= CAST('{AS_OF}' AS TIMESTAMP))) AND not_before <= CAST('{AS_OF}' AS TIMESTAMP) AND attempt < max_attempts) w ORDER BY priority DESC, depth, frontier_id")
def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "crawl_frontier", "crawl_tasks")
    return tasks.open_work(found["crawl_frontier"], found["crawl_tasks"], AS_OF).select("frontier_id", "task_id", "operation", "depth", "priority", "attempt")


@query("SELECT f.frontier_id, CASE WHEN f.frontier_id % 3 = 0 AND (CASE WHEN f.frontier_id % 2 = 0 THEN greatest(attempt - 1, 0) ELSE attempt END) >= max_attempts THEN 'failed' WHEN f.frontier_id % 3 = 0 THEN 'retryable' ELSE status END AS status, CAST(CASE WHEN f.frontier_id % 6 = 0 THEN greatest(attempt - 1, 0) ELSE attempt END AS INT) AS attempt FROM {crawl_frontier} f")
def frontier_after_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frontier = frame(spark, sf_dir, "crawl_frontier")
    told = frontier.filter("frontier_id % 3 = 0").select("frontier_id", F.lit("retryable").alias("outcome"), F.lit(None).cast("string").alias("next_cursor"), F.lit("x").alias("error_class"), (F.col("frontier_id") % 2 == 0).alias("refund"))
    return tasks.after_outcomes(frontier, told).select("frontier_id", "status", "attempt")


@query("SELECT task_id, CASE WHEN status IN ('running', 'failed') THEN 'paused' ELSE status END AS new_status, status NOT IN ('running', 'paused') AS refused FROM {crawl_tasks}")
def task_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame(spark, sf_dir, "crawl_tasks")
    return tasks.moved(found, found.select("task_id", F.lit("paused").alias("target"))).select("task_id", F.col("status").alias("new_status"), "refused")


@query("SELECT b.task_id, b.operation, greatest(CAST(0 AS BIGINT), least(b.max_requests - b.requests_attempted, t.max_requests - t.requests_attempted)) AS \"left\" FROM {task_operation_budgets} b JOIN {crawl_tasks} t ON t.task_id = b.task_id")
def budgets_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "task_operation_budgets", "crawl_tasks")
    return tasks.budgets_left(found["crawl_tasks"], found["task_operation_budgets"])


_ASKED = "SELECT f.task_id, frontier_id, CAST(attempt AS BIGINT) AS n, CAST(depth AS BIGINT) AS e, row_number() OVER (PARTITION BY f.task_id ORDER BY frontier_id) AS k, max_nodes - nodes_created AS nodes, max_edges - edges_created AS edges FROM {crawl_frontier} f JOIN {crawl_tasks} t ON t.task_id = f.task_id"
_FOLDED = "SELECT task_id, CAST(0 AS BIGINT) AS k, nodes, edges, CAST(NULL AS BIGINT) AS frontier_id, true AS fits FROM {asked} WHERE k = 1 UNION ALL SELECT a.task_id, a.k, CASE WHEN ok THEN a.left_n - a.n ELSE a.left_n END, CASE WHEN ok THEN a.left_e - a.e ELSE a.left_e END, a.frontier_id, a.ok FROM (SELECT p.*, f.nodes AS left_n, f.edges AS left_e, (p.n = 0 AND p.e = 0) OR (p.n <= f.nodes AND p.e <= f.edges) AS ok FROM {folded} f JOIN {asked} p ON p.task_id = f.task_id AND p.k = f.k + 1) a"


@query("SELECT frontier_id, fits FROM {folded} WHERE k > 0", asked=_ASKED, folded=_FOLDED)
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "crawl_frontier", "crawl_tasks")
    pages = found["crawl_frontier"].select("task_id", "frontier_id", F.col("frontier_id").alias("page_order"), F.col("attempt").alias("new_nodes"), F.col("depth").alias("new_edges"))
    return tasks.over_capacity(pages, found["crawl_tasks"]).select("frontier_id", "fits")


@query(f"SELECT t.task_id, pages_produced, pages_processed, coalesce(o.waiting, 0) AS outbox_pending, coalesce(o.dead, 0) AS outbox_dead_lettered, o.oldest AS oldest_unpublished_seconds, coalesce(d.n, 0) AS dlq_events, pages_produced - pages_processed AS backlog, pages_produced - pages_processed <= 0 AND coalesce(o.waiting, 0) = 0 AS drained FROM {{crawl_tasks}} t LEFT JOIN (SELECT task_id, count(*) FILTER (published_at IS NULL AND dead_lettered_at IS NULL) AS waiting, count(*) FILTER (dead_lettered_at IS NOT NULL) AS dead, round(epoch(CAST('{AS_OF}' AS TIMESTAMP)) - epoch(min(created_at) FILTER (published_at IS NULL AND dead_lettered_at IS NULL)), 6) AS oldest FROM {{raw_page_outbox}} GROUP BY 1) o ON o.task_id = t.task_id LEFT JOIN (SELECT task_id, count(*) AS n FROM {{dlq_events}} GROUP BY 1) d ON d.task_id = t.task_id")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(tasks.pipeline_stats(frames(spark, sf_dir, "crawl_tasks", "raw_page_outbox", "dlq_events"), AS_OF))


@query(f"SELECT task_id, event_id FROM (SELECT * FROM {{raw_page_outbox}} WHERE published_at IS NULL AND dead_lettered_at IS NULL AND not_before <= CAST('{AS_OF}' AS TIMESTAMP) ORDER BY created_at, task_id, event_id LIMIT 20) x")
def outbox_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.outbox_due(frame(spark, sf_dir, "raw_page_outbox"), AS_OF).select("task_id", "event_id")


@query("SELECT published_at IS NOT NULL OR bad = 0 AS published, dead_lettered_at IS NOT NULL OR coalesce(bad = 1 AND attempts >= 5, false) AS dead, coalesce(bad = 1, false) AND attempts < 5 AS put_off, count(*) AS n FROM (SELECT *, CASE WHEN published_at IS NOT NULL THEN NULL WHEN length(event_id) % 2 = 0 THEN 1 ELSE 0 END AS bad FROM {raw_page_outbox}) o GROUP BY ALL")
def outbox_after_publishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = frame(spark, sf_dir, "raw_page_outbox")
    tried = outbox.filter(F.col("published_at").isNull()).select("task_id", "event_id", F.when(F.char_length("event_id") % 2 == 0, F.lit("broker away")).alias("error"))
    rows = tasks.after_publishing(outbox, tried, AS_OF).join(tried.select("task_id", "event_id", F.coalesce(F.col("error").isNotNull(), F.lit(False)).alias("bad")), ["task_id", "event_id"], "left")
    return rows.groupBy(F.col("published_at").isNotNull().alias("published"), F.col("dead_lettered_at").isNotNull().alias("dead"), (F.coalesce("bad", F.lit(False)) & (F.col("attempts") < 5)).alias("put_off")).agg(F.count(F.lit(1)).alias("n"))


_HISTORY = """
    SELECT *, count(*) FILTER (size = 0) OVER (PARTITION BY chain, filled ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS empty_run,
           cursor_out IS NOT NULL AND row_number() OVER (PARTITION BY chain, cursor_out ORDER BY page_no) > 1 AS again
    FROM (SELECT *, row_number() OVER w AS n, count(*) FILTER (size > 0) OVER w AS filled, sum(n_own) OVER w AS scanned, sum(n_qualifying) OVER w AS qualifying
          FROM (SELECT *, account_id AS chain, n_users AS size FROM {chain_pages}) p WINDOW w AS (PARTITION BY chain ORDER BY page_no ROWS UNBOUNDED PRECEDING)) q"""
_ENDS = "SELECT *, min(CASE WHEN reason IS NOT NULL THEN n END) OVER (PARTITION BY chain) AS stop FROM (SELECT *, CASE WHEN empty_run >= 3 THEN 'empty_pages' WHEN cursor_out IS NULL THEN 'natural_end' WHEN again THEN 'cursor_stalled' %s END AS reason FROM {history}) r"


@query("SELECT task_id, account_id, count(*) AS pages, max(reason) AS reason, CAST(sum(n_users) AS BIGINT) AS users FROM {ends} WHERE stop IS NULL OR n <= stop GROUP BY ALL", history=_HISTORY, ends=_ENDS % "WHEN n >= 4 THEN 'page_limit'")
def expansion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.expansion_outcomes(frame(spark, sf_dir, "chain_pages"), max_pages=4)


@query("SELECT task_id, account_id, count(*) AS pages, max(reason) AS reason, CAST(max(scanned) AS BIGINT) AS scanned, CAST(max(qualifying) AS BIGINT) AS qualifying FROM {ends} WHERE stop IS NULL OR n <= stop GROUP BY ALL", history=_HISTORY, ends=_ENDS % "WHEN qualifying >= 20 THEN 'target_reached' WHEN scanned >= 90 THEN 'scan_limit' WHEN n >= 5 THEN 'page_limit'")
def timeline_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.timeline_outcomes(frame(spark, sf_dir, "chain_pages"), target_posts=20, max_scanned=90, max_pages=5)


@query(
    "SELECT account_id AS chain_id, count(*) AS pages, max(reason) AS reason, CAST(sum(CASE WHEN stalled THEN 0 ELSE size END) AS BIGINT) AS items FROM {told} WHERE stop IS NULL OR n <= stop GROUP BY 1",
    history=_HISTORY,
    told="SELECT *, min(CASE WHEN reason IS NOT NULL THEN n END) OVER (PARTITION BY chain) AS stop FROM (SELECT *, CASE WHEN stalled THEN 'stalled' WHEN empty_run >= 3 THEN 'empty_pages' WHEN cursor_out IS NULL THEN 'end' WHEN size > 0 AND total >= 100 THEN 'limit' END AS reason FROM (SELECT *, coalesce(cursor_out = lag(cursor_out) OVER w, false) OR coalesce(size > 0 AND size = lag(size) OVER w, false) AS stalled, sum(size) OVER (PARTITION BY chain ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS total FROM {history} WINDOW w AS (PARTITION BY chain ORDER BY page_no)) s) r",
)
def pagination_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "chain_pages")
    ids = F.transform(F.when(F.col("n_users") > 0, F.sequence(F.lit(1), F.col("n_users"))).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string"))
    return chains.pagination_outcomes(pages.select(F.col("account_id").alias("chain_id"), F.lit("SearchTimeline").alias("queue"), "page_no", ids.alias("entry_ids"), "cursor_out"), limit=100)


TALK = "SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id_str, concat(CAST(conv_id AS STRING), '-0') AS conversation_id, CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), '-', CAST(turn - 1 AS STRING)) END AS in_reply_to_id, turn FROM {conversations}"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TALK, conversations=frame(spark, sf_dir, "conversations"))


@query("SELECT * FROM {talk} WHERE conversation_id = '7-0'", talk=TALK)
def thread_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.thread(_talk(spark, sf_dir), "7-0")


@query("SELECT * FROM {talk} WHERE in_reply_to_id = '7-0'", talk=TALK)
def direct_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.replies(_talk(spark, sf_dir), "7-0")


@query("SELECT event_id FROM {events} WHERE event_id % 4 <> 0 OR event_id % 6 = 0")
def media_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda test: F.when(test, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    posts = frame(spark, sf_dir, "events").select("event_id", some(F.col("event_id") % 4 == 1).alias("photos"), some(F.col("event_id") % 4 > 1).alias("videos"), some(F.col("event_id") % 6 == 0).alias("animated"))
    return feeds.with_media(posts).select("event_id")


RAW_LISTS = "SELECT c_custkey AS list_id, concat('@', c_mktsegment, ', https://x.com/u', CAST(c_custkey AS STRING), '?s=1', chr(10), ' U', CAST(c_custkey AS STRING), chr(10), 'not a handle!,', chr(10), '@@x', chr(10), CAST(c_nationkey AS STRING)) AS raw FROM {customer}"


@query(
    "SELECT list_id, array_to_string(list_filter([seg, 'u' || CAST(list_id AS STRING), nat], lambda x: x IS NOT NULL), '|') AS handles, 'U' || CAST(list_id AS STRING) AS duplicates, 'not a handle!|@@x' AS invalid, CAST(6 AS BIGINT) AS total_lines, CAST(3 AS INT) AS valid_count FROM (SELECT c_custkey AS list_id, c_mktsegment AS seg, CAST(c_nationkey AS STRING) AS nat FROM {customer}) c"
)
def seed_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(seeds.seed_import(spark.sql(RAW_LISTS, customer=frame(spark, sf_dir, "customer"))))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'retweet' WHEN event_id % 5 = 0 THEN 'reply' WHEN event_id % 3 = 0 OR event_id % 11 = 0 THEN 'quote' ELSE 'original' END AS kind, NOT (event_id % 7 = 0 OR event_id % 5 = 0) AS is_qualifying, event_id % 7 <> 0 AND event_id % 5 = 0 AND event_id % 2 = 0 AS is_self_thread_reply FROM {events}")
def post_kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    when = lambda k: F.when(e % k == 0, F.lit("1"))
    rows = frame(spark, sf_dir, "events").withColumn("kind", rules.post_kind(when(7), when(5), when(3), e % 11 == 0))
    return rows.select("event_id", "kind", rules.is_qualifying(F.col("kind")).alias("is_qualifying"), rules.is_self_thread_reply(F.col("kind"), when(2), F.lit("1")).alias("is_self_thread_reply"))


@query(
    "SELECT k AS id, CASE WHEN k % 13 = 0 THEN 'blocked' WHEN status = 429 OR (remaining = 0 AND k % 4 <> 0) THEN 'rate_limited' WHEN k % 17 = 0 THEN 'invalid_response' WHEN code = 336 THEN 'features_outdated' WHEN code = 88 AND remaining > 0 THEN 'account_unavailable' WHEN code = 326 THEN 'account_unavailable' WHEN code = 32 THEN 'authentication' WHEN code = -1 THEN 'platform_overloaded' WHEN status = 403 AND code IS NULL THEN 'authentication' WHEN status >= 400 THEN 'invalid_response' END AS response_class FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS status, o_orderkey % 3 AS remaining, CASE o_orderkey % 8 WHEN 0 THEN 336 WHEN 1 THEN 88 WHEN 2 THEN 326 WHEN 3 THEN 32 WHEN 4 THEN -1 END AS code FROM {orders}) o"
)
def response_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 429, 500, 200))), (k % 5 + 1).cast("int"))
    code = F.get(F.array(*map(F.lit, (336, 88, 326, 32, -1))), (k % 8).cast("int"))
    codes = F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<int>"))
    messages = F.when(code == -1, F.array(F.lit("Loadshed now"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(k % 13 == 0, "text/html; charset=utf-8").otherwise("application/json")
    headers = F.map_from_arrays(F.array(*map(F.lit, ("Content-Type", "x-rate-limit-remaining", "x-rate-limit-reset"))), F.array(kind, (k % 3).cast("string"), F.when(k % 4 == 0, "soon").otherwise("1760000000")))
    rows = frame(spark, sf_dir, "orders").withColumns({"status": status, "codes": codes, "messages": messages, "headers": headers})
    return rows.select(k.alias("id"), rules.response_class(F.col("status"), F.col("headers"), k % 17 != 0, F.col("codes"), F.col("messages")).alias("response_class"))


@query("SELECT o_orderkey AS id, sha256('Following' || chr(0) || CAST(o_custkey AS STRING) || chr(0) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c' || CAST(o_orderkey AS STRING) END) AS event_id FROM {orders}")
def page_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("c"), F.col("o_orderkey").cast("string")))
    return frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), rules.page_identity(F.lit("Following"), F.col("o_custkey").cast("string"), cursor).alias("event_id"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM {orders} WHERE o_custkey % 10 <> 0 GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderkey) FROM {orders} WHERE o_custkey % 10 = 0 GROUP BY 1")
def first_version_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frame(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    table = orders.filter("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return records.first_wins(table, orders, ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS k FROM {orders}) o WHERE k = 1")
def latest_version_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = frame(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    old = orders.filter("o_orderkey % 5 = 0").dropDuplicates(["o_custkey"])
    return records.latest_wins(old, orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


#: Keys of customers or events that a page spans, so that none holds more rows, whatever its nation or user has.
SPAN = 5000


def _pages_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (page, part) for each nation, with its customers as user objects: half of them in the nested layout, half in the flat one."""
    c = frame(spark, sf_dir, "customer")
    key, number = F.col("c_custkey"), F.col("c_custkey").cast("string")
    nested = F.struct(F.lit("User").alias("__typename"), number.alias("rest_id"), F.struct(F.col("c_name").alias("screen_name")).alias("core"), F.struct(F.floor("c_acctbal").alias("followers")).alias("relationship_counts"), F.struct((key % 3 == 0).alias("can_dm")).alias("dm_permissions"))
    flat = F.struct(F.lit("User").alias("__typename"), F.struct(number.alias("id_str"), F.col("c_name").alias("screen_name"), F.floor("c_acctbal").cast("string").alias("followers_count")).alias("legacy"))
    both = F.when(key % 2 == 0, F.to_json(nested)).otherwise(F.to_json(flat))
    listed = F.concat(F.lit('{"data":{"users":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, both.alias("o")))), lambda x: x["o"]), ","), F.lit("]}}"))
    return c.groupBy(F.col("c_nationkey").cast("string").alias("page"), F.floor(key / SPAN).alias("part")).agg(listed.alias("payload"))


@query("SELECT CAST(c_nationkey AS STRING) AS page, CAST(c_custkey AS STRING) AS account_id, c_name AS username, CAST(floor(c_acctbal) AS INT) AS followers_count, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 END AS can_dm, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS position FROM {customer}")
def parse_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(parse.users(_pages_of_customers(spark, sf_dir), ["page", "part"]))
    # a row for each page: places go on from the pages before
    sizes = found.groupBy("page", "part").agg(F.max("position").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("page").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.join(sizes.select("page", "part", before.alias("before")), ["page", "part"])
    return found.withColumn("position", (F.col("position") + F.col("before")).cast("int")).select("page", "account_id", "username", "followers_count", "can_dm", "position")


def _pages_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline pages (page, part) for each user of the events, with advertisements in them."""
    e = frame(spark, sf_dir, "events")
    n, when = F.col("event_id"), lambda k, v: F.when(F.col("event_id") % k == 0, v)
    legacy = F.struct(F.col("props").alias("full_text"), (n % 50).alias("favorite_count"), when(7, F.lit("5")).alias("retweeted_status_id_str"), when(5, F.lit("6")).alias("in_reply_to_status_id_str"))
    result = F.struct(F.lit("Tweet").alias("__typename"), n.cast("string").alias("rest_id"), legacy.alias("legacy"), F.struct(when(3, (n * 10).cast("string")).alias("count")).alias("views"))
    item = F.struct(F.lit("TimelineTweet").alias("itemType"), when(11, F.struct(F.lit(1).alias("id"))).alias("promotedMetadata"), F.struct(result.alias("result")).alias("tweet_results"))
    entry = F.struct(F.struct(F.lit("TimelineTimelineItem").alias("entryType"), item.alias("itemContent")).alias("content"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct(n.alias("n"), F.to_json(entry).alias("o")))), lambda x: x["o"])
    payload = F.concat(F.lit('{"x":[{"type":"TimelineAddEntries","entries":['), F.array_join(entries, ","), F.lit(']},{"cursorType":"Bottom","value":"next"}]}'))
    return e.groupBy(F.col("user_id").cast("string").alias("page"), F.floor(n / SPAN).alias("part")).agg(payload.alias("payload"))


@query("SELECT CAST(user_id AS STRING) AS page, CAST(event_id AS STRING) AS post_id, CASE WHEN event_id % 7 = 0 THEN 'retweet' WHEN event_id % 5 = 0 THEN 'reply' ELSE 'original' END AS kind, CAST(event_id % 50 AS INT) AS like_count, CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 10 AS INT) END AS view_count FROM {events} WHERE event_id % 11 <> 0")
def parse_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.posts(_pages_of_events(spark, sf_dir), ["page", "part"]).select("page", "post_id", "kind", "like_count", "view_count")


@query("SELECT DISTINCT CAST(user_id AS STRING) AS page, 'next' AS cursor FROM {events}")
def parse_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.cursors(_pages_of_events(spark, sf_dir), ["page", "part"]).select("page", "cursor").distinct()


POOL = "SELECT c_custkey, c_name AS username, c_custkey % 3 <> 0 AS active, c_custkey % 4 AS used FROM {customer}"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    until = F.when(k % 2 == 0, F.lit("2026-02-01 00:00:00")).otherwise(F.lit("2025-02-01 00:00:00")).cast("timestamp")
    locks = F.when(k % 5 == 0, F.create_map(F.lit("Following"), until)).when(k % 5 == 1, F.create_map(F.lit("UserTweets"), until)).otherwise(F.create_map().cast("map<string,timestamp>"))
    used = F.when(k % 4 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + k % 4))
    stats = F.create_map(F.lit("a"), (k % 4).cast("bigint"), F.lit("b"), F.lit(0).cast("bigint"))
    return c.select(F.col("c_name").alias("username"), (k % 2 == 0).alias("has_session"), F.lit("cookies").alias("login_method"), (k % 3 != 0).alias("active"), used.alias("last_used"), F.lit(None).cast("string").alias("error_msg"), locks.alias("locks"), stats.alias("stats"))


@query("SELECT 'total' AS name, count(*) AS n FROM {customer} UNION ALL SELECT 'active', count(*) FROM {customer} WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'inactive', count(*) FROM {customer} WHERE c_custkey % 3 = 0 UNION ALL SELECT 'locked_Following', count(*) FROM {customer} WHERE c_custkey % 10 = 0 UNION ALL SELECT 'locked_UserTweets', count(*) FROM {customer} WHERE c_custkey % 10 = 6")
def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool_stats(_pool(spark, sf_dir), AS_OF)


@query("SELECT username, active, used AS total_req, 'None' AS error_msg FROM {pool}", pool=POOL)
def account_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.account_info(_pool(spark, sf_dir)).select("username", "active", "total_req", "error_msg")


@query("SELECT event_type, event_id % 3 AS third, count(*) AS n FROM {events} GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.counters(frame(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3).alias("third")), ["event_type", "third"])


_CELL = lambda c: f"coalesce(CAST({c} AS STRING), '') AS {c}"


@query(f"SELECT {', '.join(map(_CELL, ('account_id', 'username', 'first_depth', 'trees', 'can_dm', 'followers_count', 'declared_following', 'warnings')))} FROM {{listed}} WHERE can_dm = true", listed=LISTED, metrics=METRICS)
def export_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.as_cells(export.accounts(model(spark, sf_dir), TASK, listing.AccountFilter(can_dm=True)))
    return rows.select("account_id", "username", "first_depth", "trees", "can_dm", "followers_count", "declared_following", "warnings")


@query(f"SELECT {', '.join(map(_CELL, ('source_account_id', 'target_account_id', 'source_depth', 'trees', 'is_collision')))} FROM {{edges}}", edges=EDGES)
def export_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.as_cells(export.relationships(model(spark, sf_dir), TASK, listing.EdgeFilter()))
    return rows.select("source_account_id", "target_account_id", "source_depth", "trees", "is_collision")


@query(f"SELECT {', '.join(map(_CELL, ('account_id', 'post_id', 'kind', 'is_qualifying', 'like_count', 'view_count', 'text')))} FROM {{account_posts}}")
def export_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.as_cells(export.posts(model(spark, sf_dir), TASK))
    return rows.select("account_id", "post_id", "kind", "is_qualifying", "like_count", "view_count", "text")


@query("SELECT 't1' AS task_id, 'accounts' AS dataset, 'running' AS task_status, false AS expansion_complete, CAST(10 AS BIGINT) AS parser_backlog, (SELECT count(*) FROM {account_nodes} WHERE expansion_status = 'complete') AS expanded")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import UTC, datetime

    found = model(spark, sf_dir) | frames(spark, sf_dir, *WORK)
    told = export.manifest(found, TASK, "accounts", listing.AccountFilter().as_dict(), 0, datetime(2026, 1, 1, tzinfo=UTC), AS_OF, "parser")
    row = (told["task_id"], told["dataset"], told["task_status"], told["expansion_complete"], told["parser_backlog"], told["coverage"]["expanded"])
    return spark.createDataFrame([row], "task_id string, dataset string, task_status string, expansion_complete boolean, parser_backlog bigint, expanded bigint")


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream made from the tables: pages of customers, delivered twice, with broken and foreign ones."""
    from fernweave.sources.events import encoded

    pages = _pages_of_customers(spark, sf_dir)
    told = {"event_id": F.concat(F.lit("p"), "page", F.lit("-"), F.col("part").cast("string")), "schema_version": F.lit(1), "tree_id": F.lit("tree-a"), "account_id": F.concat(F.lit("n"), "page"), "depth": F.lit(1)}
    told |= {"task_id": F.when(F.col("page").cast("int") % 10 == 9, "gone").otherwise("t1"), "operation": F.when(F.col("page").cast("int") % 10 == 8, "UserByScreenName").otherwise("Following")}
    told |= {c: F.lit(None).cast("string") for c in ("cursor_in", "cursor_out")} | {"status_code": F.lit(200), "requested_at": F.lit(None).cast("timestamp"), "received_at": F.lit(None).cast("timestamp"), "rate_limit": F.lit(None).cast("struct<limit:int,remaining:int,reset_at:string>")}
    good = encoded(pages.withColumns(told).drop("part")).select("value")
    return good.unionByName(good).unionByName(spark.createDataFrame([("{broken",), (json.dumps({"event_id": "x"}),)], "value string"))


@query("SELECT concat('n', CAST(c_nationkey AS STRING)) AS source, CAST(c_custkey AS STRING) AS target, CAST(floor(c_acctbal) AS INT) AS followers FROM {customer} WHERE c_nationkey % 10 NOT IN (8, 9)")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as files, read as a stream in several batches, applied, and applied again by a second start."""
    import uuid

    from fernweave.common import ensure_checkpoint_dir
    from fernweave.sources.events import from_files
    from fernweave.streaming import ingest

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    page_messages(spark, sf_dir).repartition(3).write.text(f"{path}/in")
    store = ingest.Store(spark, path)
    known = spark.createDataFrame([("t1",)], "task_id string")
    for _ in range(2):
        ingest.start(from_files(spark, f"{path}/in", files_per_batch=1).select("value"), store, known).awaitTermination()
    return store.get("listed", ingest.EDGE_ROWS).select("source", "target", "followers")


from fernweave.plans import page_queries, state_queries, stream_queries  # noqa: E402, F401 - they register their queries
