"""Queries over the state of tasks and streams: creation, progress, dead letters, tables of a stream, files read back."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import ensure_checkpoint_dir
from fernweave.functions import rules
from fernweave.operators import admission, graph, listing, parse, records, tasks
from fernweave.plans import export
from fernweave.plans.queries import EDGES, SUB_NODES, _pages_of_customers, _plain, model, page_messages, query
from fernweave.sources import events
from fernweave.sources.adapters import AS_OF, TASK, frame, frames
from fernweave.streaming import ingest, tables


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT * FROM {edges} WHERE source_account_id = '5' UNION ALL SELECT * FROM {edges} WHERE target_account_id = '7'", edges=EDGES)
def relationships_of_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model(spark, sf_dir)
    rows = [listing.relationship_rows(found, TASK, wanted).drop("first_seen_at") for wanted in (listing.EdgeFilter(source_id="5"), listing.EdgeFilter(target_id="7"))]
    return _plain(rows[0].unionByName(rows[1]))


@query("SELECT * FROM {sub_nodes}", sub_nodes=SUB_NODES.replace("WHERE n.account_id IN (SELECT account_id FROM {near}) ", ""))
def subgraph_without_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(model(spark, sf_dir), TASK, node_limit=60).nodes


@query("SELECT frontier_id, CASE WHEN status IN ('pending', 'retryable') AND attempt >= max_attempts THEN 'failed' ELSE status END AS status FROM {crawl_frontier}")
def frontier_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.exhausted(frame(spark, sf_dir, "crawl_frontier")).select("frontier_id", "status")


@query("SELECT n.account_id, CASE WHEN CAST(n.account_id AS BIGINT) % 3 = 0 THEN coalesce(CASE WHEN CAST(n.account_id AS BIGINT) % 2 = 0 THEN 17 END, p.following_count, n.declared_following) ELSE n.declared_following END AS declared_following FROM {account_nodes} n LEFT JOIN {account_profiles} p ON p.account_id = n.account_id")
def declared_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames(spark, sf_dir, "account_nodes", "account_profiles")
    number = F.col("account_id").cast("bigint")
    told = found["account_nodes"].filter(number % 3 == 0).select("task_id", "account_id", F.when(number % 2 == 0, F.lit(17)).alias("declared"))
    return records.declared_following(found["account_nodes"], told, found["account_profiles"]).select("account_id", "declared_following")


@query("SELECT account_id, CASE WHEN account_id = '3' THEN 'complete' ELSE timeline_status END AS timeline_status FROM {account_nodes}")
def nodes_after_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame(spark, sf_dir, "account_nodes").withColumn("timeline_reason", F.lit(None).cast("string"))
    return admission.with_timeline_state(found, TASK, "3", "complete").select("account_id", "timeline_status")


@query("SELECT o_orderkey AS id, CAST(500 AS BIGINT) AS \"limit\", CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS BIGINT) AS remaining, CASE WHEN o_orderkey % 4 > 0 THEN '2025-10-09 08:53:20' END AS reset_at, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 > 0 THEN '2025-10-09 08:53:20' WHEN o_orderkey % 2 = 0 THEN '2026-01-01 00:15:00' END AS held_until FROM {orders}")
def rate_limit_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("X-Rate-Limit-Limit", "x-rate-limit-remaining", "x-rate-limit-reset")))
    headers = F.map_from_arrays(names, F.array(F.lit("500"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("none"), F.when(k % 4 > 0, "1760000000").otherwise("soon")))
    rows = frame(spark, sf_dir, "orders").select(k.alias("id"), headers.alias("h"), F.when(k % 2 == 0, "rate_limited").alias("said"))
    held = rules.held_back_until(F.col("said"), F.col("h"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    told = rows.select("id", rules.rate_limit(F.col("h")).alias("r"), held.alias("held_until"))
    return _plain(told.select("id", "r.limit", "r.remaining", "r.reset_at", "held_until"))


_ENTRY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'cursor-bottom-' WHEN '2-HIGH' THEN 'messageprompt-' WHEN '3-MEDIUM' THEN 'tweet-' WHEN '4-NOT SPECIFIED' THEN 'who-to-follow-' ELSE 'profile-conversation-' END"


@query(
    f"SELECT id, coalesce(string_agg(entry, '|' ORDER BY o_orderkey) FILTER (NOT regexp_matches(entry, '^({'|'.join(rules.NOT_CONTENT)})')), '') AS entries FROM (SELECT o_custkey AS id, o_orderkey, concat({_ENTRY}, CAST(o_orderkey AS STRING)) AS entry FROM {{orders}}) e GROUP BY id"
)
def timeline_content_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each customer's timeline, an order each, of kinds by their priority."""
    entry = F.struct(F.col("o_orderkey").alias("k"), F.concat(F.expr(_ENTRY), F.col("o_orderkey").cast("string")).alias("entryId"))
    held = frame(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return held.select("id", F.array_join(F.transform(rules.content_entries(F.col("entries")), lambda e: e["entryId"]), "|").alias("entries"))


@query("SELECT CAST(c_custkey AS STRING) AS page, CASE WHEN c_custkey % 3 = 1 THEN 'below' WHEN c_custkey % 3 = 2 THEN 'rest' END AS cursor FROM {customer} WHERE c_custkey % 3 > 0")
def cursor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = {0: {"cursorType": "Top", "value": "above"}, 1: {"a": {"next_cursor": "rest"}, "b": {"cursorType": "Bottom", "value": "below"}}, 2: {"a": {"next_cursor": "rest"}}}
    payload = F.element_at(F.array(*[F.lit(json.dumps(v)) for v in kinds.values()]), (k % 3 + 1).cast("int"))
    return parse.cursors(frame(spark, sf_dir, "customer").select(k.cast("string").alias("page"), payload.alias("payload")), ["page"], fallback=True)


@query(
    "SELECT page, CASE WHEN n = 1 THEN CAST(c AS STRING) END AS account_id, CASE WHEN n <> 1 THEN concat('users on this page, not one: ', CAST(n AS STRING)) END AS error FROM (SELECT CASE WHEN c_nationkey % 2 = 0 THEN concat('s', CAST(c_custkey AS STRING)) ELSE concat('m', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING)) END AS page, count(*) AS n, min(c_custkey) AS c FROM {customer} GROUP BY 1) x"
)
def parse_single_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, on pages of their own or with up to three others."""
    key = F.col("c_custkey")
    obj = F.to_json(F.struct(F.lit("User").alias("__typename"), key.cast("string").alias("rest_id"), F.struct(F.col("c_name").alias("screen_name")).alias("core")))
    page = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("s"), key.cast("string"))).otherwise(F.concat(F.lit("m"), F.floor(key / 4).cast("string")))
    pages = frame(spark, sf_dir, "customer").groupBy(page.alias("page")).agg(F.concat(F.lit('{"u":['), F.array_join(F.collect_list(obj), ","), F.lit("]}")).alias("payload"))
    return parse.single_user(pages, ["page"]).select("page", "account_id", "error")


@query("SELECT * FROM (VALUES ('11', 'seed', 'new', 'Following', 0), ('12', 'seed', 'new', 'Following', 0)) v(account_id, kind, task_id, operation, depth) UNION ALL SELECT account_id, 'old', task_id, operation, depth FROM {crawl_frontier}")
def task_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new task's work beside the work that is there, added twice."""
    new = tasks.created(spark, tasks.TaskSpec("new", {"seed-a": "11", "seed-b": "12"}))
    table = frame(spark, sf_dir, "crawl_frontier").select("account_id", "task_id", "operation", "depth", "status", F.lit("old").alias("kind"))
    keys = ["task_id", "account_id", "operation"]
    work = new["crawl_frontier"].withColumn("kind", F.lit("seed")).drop("tree_id")
    return tasks.added(tasks.added(table, work, keys), work, keys).select("account_id", "kind", "task_id", "operation", "depth")


@query(
    f"SELECT 'work' AS part, concat(operation, '/', status) AS name, count(*) AS n FROM {{crawl_frontier}} WHERE task_id = 't1' GROUP BY ALL UNION ALL SELECT 'error', e, n FROM (SELECT last_error_class AS e, count(*) AS n FROM {{crawl_frontier}} WHERE task_id = 't1' AND last_error_class IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10) x "
    f"UNION ALL SELECT 'waiting', 'rate_limit', count(*) FROM {{crawl_frontier}} WHERE task_id = 't1' AND status = 'retryable' AND not_before > CAST('{AS_OF}' AS TIMESTAMP) HAVING count(*) > 0 UNION ALL SELECT 'nodes', expansion_status, count(*) FROM {{account_nodes}} WHERE task_id = 't1' GROUP BY ALL UNION ALL SELECT 'layer', CAST(first_depth AS STRING), count(*) FROM {{account_nodes}} WHERE task_id = 't1' GROUP BY ALL"
)
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.progress(frames(spark, sf_dir, "crawl_frontier", "account_nodes"), TASK, AS_OF)


#: What a work item raised, by its key; the last kind but one has no name of its own, the last raised nothing.
_RAISED = [*rules.ERROR_CLASSES, "KeyError"]


@query(
    "SELECT frontier_id AS id, status, CASE frontier_id % 9 WHEN 0 THEN 'account_unavailable' WHEN 1 THEN 'authentication' WHEN 2 THEN 'blocked' WHEN 3 THEN 'features_outdated' WHEN 4 THEN 'platform_overloaded' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'transport' WHEN 7 THEN 'KeyError' END AS error_class FROM {crawl_frontier}"
)
def error_class_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each work item failed with, by the name under which it is counted."""
    raised = F.get(F.array(*map(F.lit, _RAISED)), (F.col("frontier_id") % 9).cast("int"))
    return frame(spark, sf_dir, "crawl_frontier").select(F.col("frontier_id").alias("id"), "status", rules.error_class(raised).alias("error_class"))


_CAME = (
    "SELECT frontier_id AS k, task_id, frontier_id % 4 <> 0 AS fresh, CASE WHEN frontier_id % 3 > 0 THEN concat('c', CAST(frontier_id AS STRING)) END AS next_cursor, "
    "frontier_id % 3 > 0 AND (frontier_id % 5 = 0 OR (frontier_id % 5 = 1 AND owner_id IS NULL)) AS refused FROM {crawl_frontier}"
)
_KEPT = "SELECT * FROM {came} WHERE fresh AND NOT refused"


@query(
    "SELECT 'page' AS part, event_id AS name, operation AS told FROM {raw_page_outbox} UNION ALL SELECT 'page', concat('p', CAST(k AS STRING)), 'Following' FROM {kept} UNION ALL SELECT 'refused', concat('p', CAST(k AS STRING)), 'Following' FROM {came} WHERE fresh AND refused "
    "UNION ALL SELECT 'task', t.task_id, CAST(pages_produced + (SELECT count(*) FROM {kept} q WHERE q.task_id = t.task_id) AS STRING) FROM {crawl_tasks} t UNION ALL SELECT 'item', CAST(frontier_id AS STRING), coalesce(q.next_cursor, cursor_in) FROM {crawl_frontier} f LEFT JOIN {kept} q ON q.k = f.frontier_id "
    "UNION ALL SELECT 'attempt', attempt_id, CASE WHEN outcome = 'started' AND q.k IS NOT NULL THEN 'succeeded 200' ELSE outcome END FROM {request_attempts} a LEFT JOIN {kept} q ON a.attempt_id = concat('a', CAST(q.k AS STRING), '-1')",
    came=_CAME,
    kept=_KEPT,
)
def pages_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all work, each delivered twice and a quarter of them known: the outbox and what depends on it."""
    found = frames(spark, sf_dir, "raw_page_outbox", "crawl_tasks", "crawl_frontier", "request_attempts")
    k = F.col("frontier_id")
    name = k.cast("string")
    pages = found["crawl_frontier"].select(
        "task_id", F.concat(F.when(k % 4 == 0, "e").otherwise("p"), name).alias("event_id"), F.lit("Following").alias("operation"), "frontier_id", F.when(k % 3 > 0, F.concat(F.lit("c"), name)).alias("next_cursor"),
        F.when(k % 5 == 0, "other").when(k % 5 == 1, "w").alias("owner"), F.concat(F.lit("a"), name, F.lit("-1")).alias("attempt_id"), F.lit(200).alias("status_code"), F.lit(AS_OF).cast("timestamp").alias("received_at"),
    )
    after = tasks.recorded(found, pages.unionByName(pages))
    told = [("page", "raw_page_outbox", "event_id", F.col("operation")), ("refused", "refused", "event_id", F.col("operation")), ("task", "crawl_tasks", "task_id", F.col("pages_produced").cast("string"))]
    told += [("item", "crawl_frontier", "frontier_id", F.col("cursor_in")), ("attempt", "request_attempts", "attempt_id", F.concat_ws(" ", "outcome", F.col("status_code").cast("string")))]
    parts = [after[table].select(F.lit(part).alias("part"), F.col(key).cast("string").alias("name"), value.alias("told")) for part, table, key, value in told]
    return reduce(DataFrame.unionByName, parts)


_STREAMED: dict[tuple, ingest.Store] = {}


def _streamed(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """The stream of _run_stream, run once for all queries of a session over the same tables."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.getCheckpointDir(), sf_dir)
    if key not in _STREAMED:
        _STREAMED.clear()
        _STREAMED[key] = _run_stream(spark, sf_dir)
    return _STREAMED[key]


def _run_stream(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """The stream of customers' pages, delivered twice, in a store that was started twice."""
    path = _folder(spark, "stream")
    page_messages(spark, sf_dir).repartition(3).write.text(f"{path}/in")
    store = ingest.Store(spark, path)
    known = spark.createDataFrame([("t1",)], "task_id string")
    for _ in range(2):
        ingest.start(events.from_files(spark, f"{path}/in", files_per_batch=1), store, known).awaitTermination()
    return store


_APPLIED = "FROM {customer} WHERE c_nationkey % 10 NOT IN (8, 9)"


@query(
    f"SELECT CAST(c_custkey AS STRING) AS account_id, CAST(2 AS INT) AS first_depth, CASE WHEN floor(c_acctbal) < 1000 THEN 'filtered' ELSE 'queued' END AS expansion_status, CAST(1 AS BIGINT) AS network_indegree, CAST(0 AS BIGINT) AS collected_following {_APPLIED} UNION ALL SELECT concat('n', CAST(c_nationkey AS STRING)), 1, 'expanding', 0, count(*) {_APPLIED} GROUP BY c_nationkey"
)
def stream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nodes(_streamed(spark, sf_dir), min_followers=1000).drop("task_id")


@query(f"SELECT concat('n', CAST(c_nationkey AS STRING)) AS source_account_id, CAST(c_custkey AS STRING) AS target_account_id, CAST(1 AS INT) AS source_depth {_APPLIED}")
def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.edges(_streamed(spark, sf_dir)).drop("task_id")


@query(
    f"SELECT CAST(c_custkey AS STRING) AS account_id, c_name AS username, '' AS display_name, '' AS description, CAST(NULL AS STRING) AS location, CAST(floor(c_acctbal) AS INT) AS followers_count, CAST(NULL AS INT) AS following_count, CAST(NULL AS BOOLEAN) AS protected, CAST(NULL AS BOOLEAN) AS verified, CAST(NULL AS BOOLEAN) AS blue_verified, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 = 0 END AS can_dm {_APPLIED}"
)
def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profiles(_streamed(spark, sf_dir)).drop("task_id", "created_at")


@query(f"SELECT CAST(c_custkey AS STRING) AS account_id, 'Following' AS operation, CAST(2 AS INT) AS depth {_APPLIED} AND floor(c_acctbal) >= 1000")
def stream_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.open_expansions(_streamed(spark, sf_dir), min_followers=1000).select("account_id", "operation", "depth")


@query(
    f"SELECT 'undecodable_event' AS error_class, CAST(NULL AS STRING) AS event_id FROM range(1) UNION ALL SELECT 'undecodable_event', 'x' UNION ALL SELECT DISTINCT CASE WHEN c_nationkey % 10 = 9 THEN 'unknown_task' ELSE 'permanent_parse_error' END, concat('p', CAST(c_nationkey AS STRING), '-', CAST(CAST(floor(c_custkey / 5000) AS BIGINT) AS STRING)) FROM {{customer}} WHERE c_nationkey % 10 IN (8, 9)"
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).get("dead", ingest.DEAD).select("error_class", "event_id").distinct()


@query("SELECT 'parser' AS group_id, CAST(s.k AS INT) AS source, CAST(2 AS BIGINT) AS committed, CAST(0 AS BIGINT) AS ahead, count(*) AS applied FROM (SELECT DISTINCT c_nationkey, floor(c_custkey / 5000) FROM {customer} WHERE c_nationkey % 10 <> 9) p, (VALUES (0), (1)) s(k) GROUP BY s.k")
def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the stream of the customers' pages is after two runs, and how many events it has applied."""
    store = _streamed(spark, sf_dir)
    applied = store.ledger().groupBy("group_id").agg(F.count(F.lit(1)).alias("applied"))
    return ingest.offsets(store).join(applied, "group_id").select("group_id", "source", "committed", "ahead", "applied")


@query("SELECT account_id, post_id, kind, like_count, text FROM {account_posts}")
def export_json_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    export.write(export.posts(model(spark, sf_dir), TASK), {"dataset": "posts"}, path, "json")
    return spark.read.schema("account_id string, post_id string, kind string, like_count int, text string").json(f"{path}/rows")


@query("SELECT source_account_id, target_account_id, CAST(source_depth AS STRING) AS source_depth, nullif(trees, '') AS trees FROM {edges}", edges=EDGES)
def export_csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    export.write(export.relationships(model(spark, sf_dir), TASK, listing.EdgeFilter()), {"dataset": "relationships"}, path)
    return spark.read.option("header", True).option("escape", '"').csv(f"{path}/rows").select("source_account_id", "target_account_id", "source_depth", "trees")


@query("SELECT CAST(c_nationkey AS STRING) AS nation, count(*) AS n FROM {customer} GROUP BY 1")
def captured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files written, read whole again, and their users counted by what the payloads say."""
    path = _folder(spark, "captured")
    pages = _pages_of_customers(spark, sf_dir)
    named = pages.select(F.concat(F.lit('{"page":"'), "page", F.lit('","body":'), "payload", F.lit("}")).alias("value"))
    events.write_captured(named, path)
    found = events.captured(spark, path).withColumn("page", F.get_json_object("payload", "$.page")).filter("page IS NOT NULL")
    return parse.users(found, ["file", "page"]).groupBy(F.col("page").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
