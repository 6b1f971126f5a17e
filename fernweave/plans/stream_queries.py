"""Queries over what streams keep by key: the graph's tables, posts and metrics, ordered budgets, offsets."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import cut
from fernweave.operators import late, listing, ranks
from fernweave.operators.graph import MAX_DEPTH, Graph
from fernweave.plans.queries import _BFS, _BFS_NODES_SQL, EDGES, LISTED, METRICS, MIN_FOLLOWERS, ROOTED, _built, _lists, _plain, model, query
from fernweave.plans.state_queries import _folder
from fernweave.sources import events
from fernweave.sources.adapters import MODEL, TASK, frame, frames
from fernweave.streaming import graph_state, ingest, post_state

#: Accounts whose numbers are on one page of a list.
PAGE = 200


def _once(make):
    """What `make` gives for a session and folder, made once: queries over one stream share it."""
    held: dict[tuple, object] = {}

    @wraps(make)
    def run(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, spark.sparkContext.getCheckpointDir(), sf_dir)
        if key not in held:
            held.clear()
            held[key] = make(spark, sf_dir)
        return held[key]

    return run


def _event(rows: DataFrame, **told: object) -> DataFrame:
    """rows (event_id, account_id, payload, ...) as messages (value)."""
    given = {"schema_version": F.lit(1), "task_id": F.lit(TASK), "status_code": F.lit(200), "received_at": F.lit(None).cast("timestamp"), "rate_limit": F.lit(None).cast("struct<limit:int,remaining:int,reset_at:string>")}
    given |= {c: F.lit(None).cast("string") for c in ("cursor_in", "cursor_out")} | told
    return events.encoded(rows.withColumns(given)).select("value")


def _user(number, followers, following) -> str:
    flat = F.struct(number.alias("id_str"), F.concat(F.lit("u"), number).alias("screen_name"), followers.alias("followers_count"), following.alias("friends_count"))
    return F.to_json(F.struct(F.lit("User").alias("__typename"), flat.alias("legacy")))


def list_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the lists of all accounts that the layered build expands, as a crawler would ask for them; every third owner's page holds the owner's own profile."""
    found = frames(spark, sf_dir, "follow_edges", "account_profiles")
    owners = _built(spark, sf_dir).nodes.filter("expansion_status = 'pending'").select(F.col("account_id").alias("source"), F.col("first_depth").alias("depth"), "tree_id")
    told = found["account_profiles"].select(F.col("account_id").alias("target"), "followers_count", "following_count")
    rows = found["follow_edges"].select(F.col("source_account_id").alias("source"), F.col("target_account_id").alias("target")).join(owners, "source").join(told, "target", "left")
    number = F.col("target").cast("bigint")
    users = rows.select("source", "depth", "tree_id", F.floor(number / PAGE).alias("part"), number.alias("n"), _user(F.col("target"), F.col("followers_count"), F.col("following_count")).alias("o"))
    pages = users.groupBy("source", "depth", "tree_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "o"))), lambda x: x["o"]), ",").alias("list"))
    own = F.when(F.col("source").cast("bigint") % 3 == 0, F.concat(F.lit(","), _user(F.col("source"), F.lit(None).cast("int"), F.lit(17)))).otherwise("")
    pages = pages.select(F.concat(F.lit("l"), "source", F.lit("-"), F.col("part").cast("string")).alias("event_id"), F.col("source").alias("account_id"), "depth", "tree_id", F.timestamp_seconds(F.col("part") + 1_700_000_000).alias("requested_at"), F.concat(F.lit('{"users":['), "list", own, F.lit("]}")).alias("payload"))
    return _event(pages, operation=F.lit("Following"))


@_once
def _graph(spark: SparkSession, sf_dir: str):
    """The graph of the lists' pages, which come in no order, each twice, to a stream that is started twice."""
    path = _folder(spark, "graph-stream")
    pages = cut(list_messages(spark, sf_dir))
    pages.unionByName(pages).withColumn("k", F.xxhash64("value", F.monotonically_increasing_id())).repartition(3, "k").drop("k").write.text(f"{path}/in")
    store = ingest.Store(spark, path)
    tasks, seeds = spark.createDataFrame([(TASK,)], "task_id string"), spark.createDataFrame([(TASK, "0", "tree-a"), (TASK, "1", "tree-b")], "task_id string, account_id string, tree_id string")
    for _ in range(2):
        graph_state.start(events.from_files(spark, f"{path}/in", files_per_batch=2), store, tasks, seeds).awaitTermination()
    return graph_state.GraphTables(store).graph(TASK, seeds, MAX_DEPTH, MIN_FOLLOWERS)


@query(
    "SELECT d.account_id, t.tree AS tree_id, d.first_depth, CASE WHEN d.first_depth > 5 THEN 'boundary' WHEN d.first_depth > 0 AND f.account_id IS NOT NULL THEN 'filtered' ELSE 'pending' END AS expansion_status, coalesce(i.n, 0) AS network_indegree, coalesce(o.n, 0) AS collected_following, CASE WHEN o.n > 0 THEN coalesce(CASE WHEN CAST(d.account_id AS BIGINT) % 3 = 0 THEN 17 END, CASE WHEN i.n > 0 THEN p.following_count END) END AS declared_following FROM {depths} d LEFT JOIN {few} f ON f.account_id = d.account_id LEFT JOIN (SELECT account_id, min(tree) AS tree FROM {rooted} GROUP BY 1) t ON t.account_id = d.account_id LEFT JOIN {account_profiles} p ON p.account_id = d.account_id LEFT JOIN (SELECT target_account_id AS id, count(*) AS n FROM {built} GROUP BY 1) i ON i.id = d.account_id LEFT JOIN (SELECT source_account_id AS id, count(*) AS n FROM {built} GROUP BY 1) o ON o.id = d.account_id",
    **_BFS,
    rooted=ROOTED,
)
def stream_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.drop("is_l6_boundary", "filter_reason")


@query("SELECT * FROM {built}", **_BFS)
def stream_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges


_OBSERVED = "SELECT t.tree AS tree_id, b.target_account_id, b.source_account_id, b.source_depth, b.target_depth, NOT (b.target_depth = b.source_depth + 1 AND row_number() OVER (PARTITION BY b.target_account_id, b.target_depth = b.source_depth + 1 ORDER BY t.tree, b.source_account_id) = 1) AS is_collision FROM {built} b JOIN (SELECT account_id, min(tree) AS tree FROM {rooted} GROUP BY 1) t ON t.account_id = b.source_account_id"


@query("SELECT tree_id, target_account_id AS account_id, source_account_id AS parent_account_id, source_depth + 1 AS depth, is_collision FROM {observed}", **_BFS, rooted=ROOTED, observed=_OBSERVED)
def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).observations


@query("SELECT tree_id, count(*) AS edges, count(DISTINCT target_account_id) AS accounts, count(*) FILTER (WHERE is_collision) AS collisions, max(target_depth) AS deepest FROM {observed} GROUP BY tree_id", **_BFS, rooted=ROOTED, observed=_OBSERVED)
def stream_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tree has found, from the stream's edge observations."""
    seen = _graph(spark, sf_dir).edge_observations
    return seen.groupBy("tree_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("target_account_id").alias("accounts"), F.count_if("is_collision").alias("collisions"), F.max("target_depth").alias("deepest"))


#: The posts as pages tell them: to the second.
TOLD_POSTS = {"account_posts": MODEL["account_posts"].replace("ts AS posted_at", "date_trunc('second', ts) AS posted_at")}
#: Posts whose places on a page are together.
POSTS_A_PAGE = 40


#: Messages in a file of the timelines' stream, in the mean: one task reads a compressed file.
FILE_MESSAGES = 50_000


def timeline_messages(spark: SparkSession, sf_dir: str, files: int = 1, copies: int = 1) -> DataFrame:
    """Timeline pages of all accounts, dealt by a hash into so many partitions, each page in so many copies; later pages hold later versions of every third post, with other numbers.

    A copy is a page of its own until it has its partition, so copies of a page come in different ones, in no order. What is dealt are the columns of posts: their JSON is made where the page is.
    """
    posts = frame(spark, sf_dir, "account_posts")
    number = F.col("post_id").cast("bigint")
    versions = posts.withColumn("version", F.explode(F.when(number % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    told = F.struct(number.alias("n"), *[c for c in posts.columns if c not in ("task_id", "account_id", "is_qualifying")])
    rows = versions.select("account_id", "version", F.floor(number / POSTS_A_PAGE / 50).alias("part"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), told.alias("o"))
    page = ["account_id", "version", "part", "copy"]
    pages = rows.repartition(files, *page).groupBy(*page).agg(F.sort_array(F.collect_list("o")).alias("list"))
    later = F.col("version") * 1000
    counts = {"reply_count": "reply_count", "retweet_count": "retweet_count", "favorite_count": "like_count", "quote_count": "quote_count", "bookmark_count": "bookmark_count"}

    def entry(post):
        when = lambda kind, value: F.when(post["kind"] == kind, F.lit(value))
        legacy = F.struct(
            post["text"].alias("full_text"), F.date_format(post["posted_at"], "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"), F.col("account_id").alias("user_id_str"), *[(post[c] + later).alias(name) for name, c in counts.items()],
            when("retweet", "5").alias("retweeted_status_id_str"), when("reply", "6").alias("in_reply_to_status_id_str"), when("quote", True).alias("is_quote_status"),
        )
        result = F.struct(F.lit("Tweet").alias("__typename"), post["post_id"].alias("rest_id"), legacy.alias("legacy"), F.struct((post["view_count"] + later).cast("string").alias("count")).alias("views"))
        item = F.struct(F.lit("TimelineTweet").alias("itemType"), F.struct(result.alias("result")).alias("tweet_results"))
        return F.struct(F.struct(F.lit("TimelineTimelineItem").alias("entryType"), item.alias("itemContent")).alias("content"))

    name = F.concat_ws("-", F.lit("t"), "account_id", F.col("part").cast("string"), F.col("version").cast("string"))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("TimelineAddEntries").alias("type"), F.transform("list", entry).alias("entries"))).alias("i")))
    pages = pages.select(name.alias("event_id"), "account_id", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("tree_id"), F.timestamp_seconds(F.col("part") + F.col("version") * 1_000_000 + 1_700_000_000).alias("requested_at"), payload.alias("payload"))
    return _event(pages, operation=F.lit("UserTweets"))


@_once
def _timelines(spark: SparkSession, sf_dir: str) -> post_state.TimelineTables:
    """Posts and metrics of the timelines' pages, which come in no order, each twice, to a stream that is started twice."""
    path = _folder(spark, "timeline-stream")
    # a post has its own page or shares one, and every third has two
    files = max(3, 2 * frame(spark, sf_dir, "account_posts").count() * 4 // 3 // FILE_MESSAGES)
    with ingest.settings(spark, ingest.TIDY):
        timeline_messages(spark, sf_dir, files, copies=2).write.option("compression", "gzip").text(f"{path}/in")
    # two batches, of two thirds of the files that are there and of the rest
    part = -(-2 * len(spark.read.text(f"{path}/in").inputFiles()) // 3)
    store, tasks = ingest.Store(spark, path), spark.createDataFrame([(TASK,)], "task_id string")
    for _ in range(2):
        post_state.start(events.from_files(spark, f"{path}/in", files_per_batch=part), store, tasks).awaitTermination()
    return post_state.TimelineTables(store)


_METRIC_COLUMNS = "task_id, account_id, sample_count, scanned_count, CAST(round(sample_span_days * 86400) AS BIGINT) AS sample_span_seconds, strftime(latest_post_at, '%Y-%m-%d %H:%M:%S') AS latest_post_at, round(avg_reply, 6) AS avg_reply, round(avg_retweet, 6) AS avg_retweet, round(avg_like, 6) AS avg_like, round(avg_view, 6) AS avg_view, view_sample_count, round(median_engagement, 6) AS median_engagement, round(engagement_rate, 6) AS engagement_rate, round(reach_ratio, 6) AS reach_ratio, round(bookmark_rate, 6) AS bookmark_rate"


@query(f"SELECT {_METRIC_COLUMNS} FROM {{metrics}}", metrics=METRICS, **TOLD_POSTS)
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _timelines(spark, sf_dir).account_metrics(frame(spark, sf_dir, "account_profiles"))
    # posts are told to the second: in seconds a span is whole, in days it may end in a half that is rounded either way
    return _plain(told.withColumn("sample_span_seconds", F.round(F.col("sample_span_days") * 86400).cast("bigint")).drop("sample_span_days"))


@query(
    "SELECT account_id, post_id, kind, is_qualifying, text, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, reply_count, retweet_count, like_count, quote_count, bookmark_count, view_count, CASE WHEN kind = 'reply' THEN '6' END AS in_reply_to_tweet_id, CASE WHEN kind = 'retweet' THEN '5' END AS retweeted_tweet_id FROM {account_posts}",
    **TOLD_POSTS,
)
def stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_timelines(spark, sf_dir).stored_posts()).drop("task_id", "conversation_id", "quoted_tweet_id")


#: Batches in which posts are put into a store, and how many of them a merge takes.
FACT_BATCHES, FACT_FAN = 11, 3


@query(
    f"SELECT CAST(CAST(post_id AS BIGINT) % {FACT_BATCHES} AS BIGINT) AS batch, kind, count(*) AS posts, count(DISTINCT account_id) AS accounts, CAST(sum(like_count) AS BIGINT) AS likes FROM {{account_posts}} GROUP BY ALL",
    account_posts=MODEL["account_posts"],
)
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts, stored batch by batch and merged as batches are committed, by the batch that they came in."""
    schema = "post_id string, account_id string, kind string, like_count int"
    rows = cut(frame(spark, sf_dir, "account_posts").select("post_id", "account_id", "kind", F.col("like_count").cast("int")))
    store = ingest.Store(spark, _folder(spark, "facts"), fan=FACT_FAN)
    for batch in range(FACT_BATCHES):
        store.put(rows.filter(F.col("post_id").cast("bigint") % FACT_BATCHES == batch), "posts", batch)
        store.merge("posts", schema, batch)
    told = store.get("posts", schema).groupBy("batch", "kind")
    return told.agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("account_id").alias("accounts"), F.sum("like_count").alias("likes"))


@_once
def _late(spark: SparkSession, sf_dir: str) -> Graph:
    """The layered graph of all lists, of which a third of the accounts' come when its layers were closed."""
    rows, starts = _lists(spark, sf_dir)
    own = late.LateGraph(spark, _folder(spark, "late"), starts, MAX_DEPTH, MIN_FOLLOWERS)
    comes_late = F.pmod(F.xxhash64("source"), F.lit(3)) == 0
    for batch, part in enumerate((~comes_late, comes_late)):
        own.add(rows.filter(part), batch)
    return own.graph()


@query(_BFS_NODES_SQL, **_BFS)
def late_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).nodes.drop("tree_id", "filter_reason")


@query("SELECT tree_id, target_account_id AS account_id, source_account_id AS parent_account_id, source_depth + 1 AS depth, is_collision FROM {observed}", **_BFS, rooted=ROOTED, observed=_OBSERVED)
def late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).observations


_DEEP = "FROM {listed}) x WHERE place >= total // 2 AND place < total // 2 + 50"


@query(f"SELECT place, account_id, network_indegree, total, total // 2 + 50 < total AS truncated FROM (SELECT row_number() OVER (ORDER BY network_indegree DESC NULLS LAST, account_id) - 1 AS place, count(*) OVER () AS total, account_id, network_indegree {_DEEP}", listed=LISTED, metrics=METRICS)
def account_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the account list that begins in its middle, with the list's total and whether rows follow it."""
    rows = listing.account_rows(model(spark, sf_dir), TASK, listing.AccountFilter()).select("account_id", "network_indegree")
    index = ranks.RankIndex.build(rows, [F.col("network_indegree").desc_nulls_last(), F.col("account_id")], _folder(spark, "ranks"), range_rows=1000)
    page = index.page(50, index.total // 2)
    return page.rows.select("place", "account_id", "network_indegree", F.lit(page.total).cast("long").alias("total"), F.lit(page.truncated).alias("truncated"))


@query(
    "SELECT place, source_account_id, target_account_id, total, total // 3 + 100 < total AS truncated FROM (SELECT row_number() OVER (ORDER BY source_account_id, target_account_id) - 1 AS place, count(*) OVER () AS total, source_account_id, target_account_id FROM {edges}) x WHERE place >= total // 3 AND place < total // 3 + 100",
    edges=EDGES,
)
def relationships_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the edge list that begins after its first third."""
    rows = listing.relationship_rows(model(spark, sf_dir), TASK, listing.EdgeFilter()).select("source_account_id", "target_account_id")
    index = ranks.RankIndex.build(rows, [F.col("source_account_id"), F.col("target_account_id")], _folder(spark, "ranks"), range_rows=5000)
    page = index.page(100, index.total // 3)
    return page.rows.select("place", "source_account_id", "target_account_id", F.lit(page.total).cast("long").alias("total"), F.lit(page.truncated).alias("truncated"))
