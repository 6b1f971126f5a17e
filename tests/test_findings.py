"""Small cases of what reviews found."""

import glob
import json
import os
import random
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from fernweave.functions import rules
from fernweave.operators import chains, outreach, rich
from fernweave.plans import queries, stream_queries
from fernweave.sources import events
from fernweave.streaming import graph_state, ingest, keyed, post_state
from tests.conftest import SMALL
from tests.test_keyed import event, streamed


def page_of(name, account, posts, when):
    entries = []
    for post, likes in posts:
        result = {"__typename": "Tweet", "rest_id": post, "legacy": {"full_text": "x", "user_id_str": account, "favorite_count": likes, "created_at": f"Sat Jan 01 04:{int(post) // 60:02}:{int(post) % 60:02} +0000 2025"}, "views": {"count": "10"}}
        entries.append({"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}}}})
    return event(name, account, "UserTweets", {"i": [{"type": "TimelineAddEntries", "entries": entries}]}, when)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_of_one_task_are_not_sent_to_one_place(spark):
    """Streams have no adaptive plans: by a shuffle all pages of a task met it in one task of Spark's."""
    tasks = spark.createDataFrame([("t",)], "task_id string")
    messages = spark.createDataFrame([(page_of("p", "a", [("1", 1)], 1),)], "value string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (post_state.own_mentions(messages, tasks), graph_state.discoveries(messages, tasks), ingest.with_news(messages, tasks)):
            assert "BroadcastHashJoin" in plan_of(rows) and "SortMergeJoin" not in plan_of(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_an_account_with_more_posts_than_a_part_holds(spark, tmp_path):
    rng = random.Random(4)
    count = 5 * post_state.PART
    lines = [page_of(f"p{k}", "a", [(str(i), i) for i in range(k * 20, k * 20 + 20)], 1) for k in range(count // 20)]
    lines += [page_of(f"early{k}", "a", [(str(i), 1000 + i) for i in range(k * 20, k * 20 + 20, 2)], 0) for k in range(count // 20)]
    tasks = spark.createDataFrame([("t",)], "task_id string")
    store = streamed(spark, tmp_path, lambda m, store: post_state.start(m, store, tasks), lines, rng)
    own = post_state.TimelineTables(store)
    likes = {r["post_id"]: r["like_count"] for r in own.stored_posts().collect()}
    assert likes == {str(i): i + (1000 if i % 2 == 0 else 0) for i in range(count)}
    row = own.metrics.read().head()
    newest = [i + (1000 if i % 2 == 0 else 0) for i in range(count - 30, count)]
    assert (row["scanned_count"], row["sample_count"], row["avg_like"]) == (count, 30, sum(newest) / 30)


def test_a_captured_file_holds_one_payload(spark, tmp_path):
    rows = spark.range(0, 60, 1, 7).selectExpr("to_json(struct(id AS page)) AS value")
    events.write_captured(rows, str(tmp_path / "pages"))
    assert sorted(r["payload"].strip() for r in events.captured(spark, str(tmp_path / "pages")).collect()) == sorted(r["value"] for r in rows.collect())


def test_captured_files_count_every_customer(spark, monkeypatch):
    """Pages in several partitions: round robin put two of them into one file, which is no JSON document then."""
    monkeypatch.setattr(queries, "SPAN", 10)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = entry.queries()["captured_files"](spark, SMALL).agg({"n": "sum"}).head()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert told == spark.read.parquet(f"{SMALL}/customer.parquet").count()


def test_every_work_item_and_kind_of_failure_has_its_name(spark):
    found = entry.queries()["error_class_naming"](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert {r["error_class"] for r in found.select("error_class").distinct().collect()} == {*rules.ERROR_CLASSES.values(), "KeyError", None}


def test_a_batch_walks_its_pages_once(spark, tmp_path, monkeypatch):
    """Two tables follow from the users of a batch's pages, which were walked for each of them."""
    whole, seen = ingest.parse.users, tmp_path / "seen"

    def marked(pages, keys):
        def mark(batches):
            for batch in batches:
                with open(seen, "a") as out:
                    out.write("x" * batch.num_rows)
                yield batch

        return whole(pages.mapInArrow(mark, pages.schema), keys)

    monkeypatch.setattr(ingest.parse, "users", marked)
    user = {"__typename": "User", "rest_id": "1", "core": {"screen_name": "u"}}
    batch = spark.createDataFrame([(event(f"e{i}", "a", "Following", {"x": [user]}, i, 1),) for i in range(5)], "value string")
    store = ingest.Store(spark, str(tmp_path))
    ingest.apply_batch(store, spark.createDataFrame([("t",)], "task_id string"))(batch, 0)
    assert seen.read_text() == "x" * 5 and store.get("listed", ingest.EDGE_ROWS).count() == 5 == store.ledger().count()


def test_a_field_that_nobody_asks_for_is_not_read(spark, monkeypatch):
    monkeypatch.setattr(rich, "media", lambda v: F.struct(F.raise_error(F.lit("read")).cast("string").alias("photos")))
    post = {"__typename": "Tweet", "rest_id": "5", "core": {"user_results": {"result": {"__typename": "User", "rest_id": "1", "core": {"screen_name": "u"}}}}, "legacy": {"full_text": "x", "user_id_str": "1", "created_at": "Sat Jan 01 04:00:00 +0000 2025"}}
    pages = spark.createDataFrame([("p", json.dumps({"entries": [post]}))], "page string, payload string")
    assert [r["id_str"] for r in rich.items(rich.tweets(pages, ["page"])).select("id_str").collect()] == ["5"]


def test_chains_are_dealt_once_and_sorted_by_few(spark, monkeypatch):
    """A task had four sorts of all its pages at a time, of partitions that were merged into ones of any number of pages."""
    monkeypatch.setattr(chains, "PAGES_A_TASK", 10)
    told = [("t", f"a{k % 9}", k // 9, k % 5, k % 3, k % 2, f"c{k % 4}") for k in range(90)]
    pages = spark.createDataFrame(told, "task_id string, account_id string, page_no int, n_posts int, n_own int, n_qualifying int, cursor_out string")
    lists = pages.select(F.col("account_id").alias("chain_id"), F.lit("SearchTimeline").alias("queue"), "page_no", F.array("cursor_out").alias("entry_ids"), "cursor_out")
    for rows, sorts in ((chains.timeline_outcomes(pages), 2), (chains.expansion_outcomes(pages.withColumnRenamed("n_posts", "n_users")), 2), (chains.pagination_outcomes(lists), 1)):
        plan = plan_of(rows).split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and ", 9), REPARTITION_BY_NUM" in plan
        assert plan.count("Sort [") == sorts and rows.count() == 9


def test_unknown_sizes_are_neither_full_nor_empty_pages(spark):
    pages = spark.createDataFrame([("t", "a", k, n, f"c{k}") for k, n in enumerate([0, None, 0, 4, 0, 0, None, 0])], "task_id string, account_id string, page_no int, n_users int, cursor_out string")
    assert [tuple(r) for r in chains.expansion_outcomes(pages).collect()] == [("t", "a", 8, "empty_pages", 4)]


def test_votes_are_derived_once(spark):
    """Each use of the votes did their join and their distinct again."""
    found = queries.votes_model(spark, SMALL)
    assert "Exchange" not in plan_of(found["follow_edges"]) and "Exchange" not in plan_of(found["account_nodes"])


def test_a_pick_reads_the_words_of_near_candidates(spark, monkeypatch):
    """Each pick read the words of all candidates three times."""
    whole, read = outreach._open_votes, []

    def noted(words, reached, done, of=None):
        if of is not None:
            read.append({r["candidate"] for r in words.select("candidate").distinct().collect()})
        return whole(words, reached, done, of)

    monkeypatch.setattr(outreach, "_open_votes", noted)
    monkeypatch.setattr(outreach, "HEAD", 2)
    monkeypatch.setattr(outreach, "NEAR", 3)
    audience = {f"c{k}": [f"v{k}-{i}" for i in range(12 - k)] for k in range(8)}
    edges = spark.createDataFrame([("t", v, c) for c, vs in audience.items() for v in vs + vs[:1]], "task_id string, source_account_id string, target_account_id string")
    nodes = spark.createDataFrame([("t", c, len(vs)) for c, vs in audience.items()], "task_id string, account_id string, network_indegree int")
    profiles = nodes.select("task_id", "account_id", F.col("account_id").alias("username"), F.lit(1).alias("followers_count"), F.lit(True).alias("can_dm"))
    plan = outreach.approach_plan({"follow_edges": edges, "account_nodes": nodes, "account_profiles": profiles}, "t", nodes, picks=6, max_pool=None)
    assert [(s["account_id"], s["new_reach"]) for s in plan.steps] == [(f"c{k}", 12 - k) for k in range(6)]
    assert len(read) == 5 and all(len(near) <= 3 for near in read)


def test_timelines_come_compressed_and_twice(spark):
    """Their text was the greater part of what the stream had on disk."""
    once = sorted(r["value"] for r in stream_queries.timeline_messages(spark, SMALL).collect())
    dealt = stream_queries.timeline_messages(spark, SMALL, files=5, copies=2).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r["value"] for r in dealt) == sorted(once * 2)
    places = {}
    for r in dealt:
        places.setdefault(r["value"], set()).add(r["p"])
    assert sum(len(p) == 2 for p in places.values()) > len(once) / 2 and len({r["p"] for r in dealt}) == 5
    told = stream_queries._timelines(spark, SMALL)
    files = glob.glob(f"{told.posts.path.split('/parser/')[0]}/in/part-*".removeprefix("file:"))
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)
    assert 5 * sum(map(os.path.getsize, files)) < sum(map(len, once * 2))


def test_what_a_stream_shuffles_goes_with_its_batches(spark, tmp_path):
    """It stayed until the driver happened to collect its garbage."""
    left = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    lines, tasks, before = [page_of(f"p{k}", f"a{k}", [(str(k), k)], 1) for k in range(20)], spark.createDataFrame([("t",)], "task_id string"), left()
    store = streamed(spark, tmp_path, lambda m, store: post_state.start(m, store, tasks), lines, random.Random(1))
    until = time.time() + 20
    while left() - before and time.time() < until:
        time.sleep(0.5)
    assert not left() - before, [(f, os.path.getsize(f)) for f in left() - before if os.path.exists(f)]
    assert post_state.TimelineTables(store).stored_posts().count() == 20
    assert all(spark.conf.get(name, None) != value for name, value in ingest.TIDY.items())


def test_an_upsert_is_shuffled_once(spark, tmp_path):
    """Its rows were shuffled by key to be made one for each, and by bucket to be written."""
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v string, place int", ["k"], ["place"], "first", buckets=2)
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "k int, v string, place int")
    assert plan_of(table._run(rows.withColumn(keyed.BATCH, F.lit(0).cast("bigint")))).count("Exchange ") == 1
    table.upsert(rows, 0)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "c", 5)]


def test_posts_in_a_state_are_compressed():
    posts = {str(10**6 + 77 * i): [f"2025-01-01 00:00:{i % 60:02}", f"t-12-{i}-0", 0, 0, True, 1_700_000_000_000_000 + 8_640_000_000 * i, i % 7, i % 11, i, i % 3, i % 5, 20 * i] for i in range(post_state.PART)}
    raw = post_state.packed(posts)
    assert post_state.unpacked(raw) == posts and 2.5 * len(raw) < len(json.dumps(posts))


def test_a_message_and_an_entry_are_read_once(spark):
    """Filters on what they say were put before them, and each read the whole message or post again."""
    messages = spark.createDataFrame([(page_of("p", "a", [("1", 1)], 1),), ("{broken",)], "value string")
    rows = events.decoded(messages)
    assert plan_of(rows.filter(F.col("problem").isNull() & (F.col("operation") == "UserTweets"))).count("from_json(") == 1
    assert sorted(str(r["problem"]) for r in rows.collect()) == ["None", "missing event_id, task_id, account_id, operation, payload"]
    found = post_state.own_mentions(messages, spark.createDataFrame([("t",)], "task_id string"))
    assert plan_of(found).count(", $.content") == 1 and [(r["post_id"], r["like_count"], r["view_count"]) for r in found.collect()] == [("1", 1, 10)]
