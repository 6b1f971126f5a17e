"""Tables by key, and the graph, posts and metrics that streams keep by key, against the batch forms over the same pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fernweave.operators import graph, late, metrics
from fernweave.sources import events
from fernweave.streaming import graph_state, ingest, keyed, manifest, post_state, tables

ROWS = "source string, page_no int, position bigint, target string, followers int"


def told(df, *columns):
    return sorted(map(str, df.select(*columns or df.columns).collect()))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_a_table_by_key_is_what_its_rows_say(spark, tmp_path, keep):
    rng = random.Random(keep)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v string, place int", ["k"], ["place"], keep, buckets=4, fan=3)
    assert table.read().count() == 0 and table.manifest()["applied"] == -1
    own = {}
    for batch in range(14):
        rows = [(rng.randrange(30), f"{batch}-{i}", batch * 100 + i if rng.random() < 0.7 else -batch * 100 - i) for i in range(8)]
        for k, v, place in rows:
            if k not in own or (place < own[k][1] if keep == "first" else place > own[k][1]):
                own[k] = (v, place)
        frame = spark.createDataFrame(rows, "k int, v string, place int")
        table.upsert(frame, batch)
        if batch % 5 == 0:  # one that comes again
            table.upsert(frame.withColumn("v", F.lit("again")), batch)
    assert {r["k"]: (r["v"], r["place"]) for r in table.read().collect()} == own
    levels = [r["level"] for r in table.manifest()["runs"]]
    assert len(levels) <= 2 * 3 and max(levels) == 2 and table.manifest()["applied"] == 13
    wanted = spark.createDataFrame([(3,), (17,), (99,)], "k int")
    assert {r["k"] for r in table.lookup(wanted).collect()} == {3, 17} & set(own)
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, str(tmp_path / "u"), "k int", ["k"], keep="any")


def test_a_batch_without_its_manifest_is_not_there(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k int, v int", ["k"], buckets=2)
    table.upsert(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), 0)
    monkeypatch.setattr(table, "_swap", lambda _: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, 9)], "k int, v int"), 1)
    monkeypatch.undo()
    assert told(table.read()) == ["Row(k=1, v=1)", "Row(k=2, v=2)"]
    table.upsert(spark.createDataFrame([(1, 5)], "k int, v int"), 1)
    assert told(table.read()) == ["Row(k=1, v=5)", "Row(k=2, v=2)"]


FACT = "k int, v string"


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def test_merged_batches_are_what_was_put(spark, tmp_path):
    store, own = ingest.Store(spark, str(tmp_path), fan=3), []
    assert store.get("t", FACT).count() == 0
    most = 0
    for batch in range(32):
        rows = [(batch, f"{batch}-{i}") for i in range(batch % 4)]  # every fourth batch is empty
        store.put(facts(spark, (0, "lost")), "t", batch)  # comes again before it is committed
        store.put(facts(spark, *rows), "t", batch)
        store.merge("t", FACT, batch)
        own += [(k, v, batch) for k, v in rows]
        merged, loose = store.folders("t")
        most = max(most, len(merged) + len(loose))
    assert sorted(map(tuple, store.get("t", FACT).collect())) == sorted(own)
    for before in (0, 1, 9, 26, 31, 99):
        assert sorted(map(tuple, store.get("t", FACT, before).collect())) == sorted(r for r in own if r[2] < before), before
    # 32 batches: two of each level at most, and the loose ones
    assert most <= 2 * 3 + 4 and {m["level"] for m in store.manifest("t").read()["merged"]} == {1, 3}
    with pytest.raises(ValueError, match="merged before"):
        store.put(facts(spark, (1, "x")), "t", 5)
    with pytest.raises(ValueError):
        ingest.Store(spark, str(tmp_path), fan=1)


def test_many_batches_are_merged_at_once(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path), fan=2)
    for batch in range(9):
        store.put(facts(spark, (batch, "x")), "t", batch)
    store.merge("t", FACT, 9)
    merged, loose = store.folders("t")
    assert len(merged) == 1 and loose == [8]
    assert sorted((r["k"], r["batch"]) for r in store.get("t", FACT).collect()) == [(b, b) for b in range(9)]


def test_a_merge_without_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = ingest.Store(spark, str(tmp_path), fan=2)
    for batch in range(4):
        store.put(facts(spark, (batch, "x")), "t", batch)
    read = lambda: sorted(r["k"] for r in store.get("t", FACT).collect())
    monkeypatch.setattr(manifest.Manifest, "swap", lambda *_: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        store.merge("t", FACT, 4)
    monkeypatch.undo()
    assert read() == [0, 1, 2, 3] and store.folders("t") == ([], [0, 1, 2, 3])
    begun = store.get("t", FACT)
    store.merge("t", FACT, 4)
    # who began to read before the merge still finds the folders, and who reads now the merged ones
    assert sorted(r["k"] for r in begun.collect()) == read() == [0, 1, 2, 3]
    assert len(store.folders("t")[0]) == 1 and store.folders("t")[1] == []


def test_a_stream_merges_what_it_has_committed(spark, tmp_path):
    users = [{"__typename": "User", "rest_id": "1", "core": {"screen_name": "u1"}}]
    tell = lambda i: json.dumps({"event_id": f"e{i}", "task_id": "t", "account_id": "a", "operation": "Following", "depth": 1, "tree_id": "tree-a", "payload": {"x": users}})
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.txt").write_text(tell(i) + "\n" + tell(0) + "\n")
    store, tasks_known = ingest.Store(spark, str(tmp_path), fan=2), spark.createDataFrame([("t",)], "task_id string")
    ingest.start(events.from_files(spark, f"{tmp_path}/in", 1).select("value"), store, tasks_known).awaitTermination()
    for table in ingest.STORED:
        merged, loose = store.folders(table)
        assert merged and loose[-1] == 5, table
    assert store.get("listed", ingest.EDGE_ROWS).count() == 6
    assert sorted((r["event_id"], r["batch"]) for r in store.ledger().collect()) == [(f"e{i}", i) for i in range(6)]
    assert tables.edges(store).count() == 1


def random_lists(rng, accounts=40, hot="7"):
    """Rows of lists, some on two pages; every third account follows one; some accounts have few followers."""
    followers = {str(i): rng.choice([None, 10, 900, 900, 900]) for i in range(accounts)}
    rows = []
    for i in range(accounts):
        targets = [str(rng.randrange(accounts)) for _ in range(rng.randrange(5))] + ([hot] if i % 3 == 0 else [])
        rows += [(str(i), 1 + p // 3, p, t, followers[t]) for p, t in enumerate(targets)]
    return rows


def graphs_equal(one, other):
    for name in ("edges", "observations", "edge_observations"):
        assert told(getattr(one, name)) == told(getattr(other, name)), name
    shown = ["account_id", "tree_id", "first_depth", "is_l6_boundary", "expansion_status", "filter_reason", "network_indegree", "collected_following"]
    assert told(one.nodes, *shown) == told(other.nodes, *shown)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_pages_end_in_the_same_graph(spark, tmp_path, monkeypatch, seed):
    import fernweave.common

    monkeypatch.setattr(fernweave.common, "LEAST_HOT", 4)
    rng = random.Random(seed)
    rows = random_lists(rng)
    rng.shuffle(rows)
    seeds = spark.createDataFrame([("tree-b", "0"), ("tree-a", "3"), ("tree-c", "3")], "tree_id string, account_id string")
    own = late.LateGraph(spark, str(tmp_path / "g"), seeds, max_depth=3, min_followers=100, buckets=4)
    size = len(rows) // 2
    for batch, part in enumerate((rows[:size], rows[size : size + 4], rows[size + 4 :])):
        own.add(spark.createDataFrame(part, ROWS), batch)
    graphs_equal(own.graph(), graph.build(seeds, spark.createDataFrame(rows, ROWS), max_depth=3, min_followers=100))
    # a page that comes again makes offers, and no label changes
    assert own.add(spark.createDataFrame(rows[:3], ROWS), 3).count() == 0 and len(own.offered) == 1


def test_late_pages_read_what_they_change(spark, tmp_path):
    rows = [("s", 1, 0, "a", 9), *((f"{'as'[0]}" if k == 0 else f"c{k - 1}", 1, 1, f"c{k}", 9) for k in range(3)), *(("s", 2, k, f"x{k}", 9) for k in range(50)), *((f"x{k}", 1, 0, f"y{k}", 9) for k in range(50))]
    seeds = spark.createDataFrame([("t", "s")], "tree_id string, account_id string")
    own = late.LateGraph(spark, str(tmp_path / "g"), seeds, buckets=4)
    own.add(spark.createDataFrame(rows, ROWS), 0)
    changed = own.add(spark.createDataFrame([("s", 3, 0, "c1", 9)], ROWS), 1)  # c1 is nearer now, and so is c2
    assert {r["account_id"]: r["first_depth"] for r in changed.collect()} == {"c1": 1, "c2": 2} and sum(own.offered) == 2


def test_an_account_that_is_filtered_late_withdraws_its_list(spark, tmp_path):
    seeds = spark.createDataFrame([("t", "s")], "tree_id string, account_id string")
    first = [("s", 2, 0, "a", 900), ("a", 1, 0, "b", 900), ("b", 1, 0, "c", 900)]
    own = late.LateGraph(spark, str(tmp_path / "g"), seeds, min_followers=100, buckets=2)
    own.add(spark.createDataFrame(first, ROWS), 0)
    more = [("s", 1, 0, "a", 5)]  # the earlier page tells fewer followers
    own.add(spark.createDataFrame(more, ROWS), 1)
    graphs_equal(own.graph(), graph.build(seeds, spark.createDataFrame(first + more, ROWS), min_followers=100))
    assert own.graph().nodes.count() == 2


def streamed(spark, path, start, lines, rng, files=3):
    """The lines, each twice and in no order, in a stream that starts twice."""
    (path / "in").mkdir()
    both = lines * 2
    rng.shuffle(both)
    for k in range(files):
        (path / "in" / f"{k}.txt").write_text("\n".join(both[k::files]) + "\n")
    store = ingest.Store(spark, str(path))
    for _ in range(2):
        start(events.from_files(spark, f"{path}/in", 1), store).awaitTermination()
    return store


def event(name, account, op, payload, when, depth=None, tree=None, task="t"):
    return json.dumps({"event_id": name, "task_id": task, "account_id": account, "operation": op, "depth": depth, "tree_id": tree, "requested_at": f"2025-01-01T00:00:{when:02}Z", "payload": payload})


def test_the_graph_of_a_stream_is_the_layered_build(spark, tmp_path):
    rng = random.Random(6)
    rows = random_lists(rng, 24)
    seeds = spark.createDataFrame([("tree-b", "0"), ("tree-a", "3")], "tree_id string, account_id string")
    built = graph.build(seeds, spark.createDataFrame(rows, ROWS), max_depth=3, min_followers=100)
    lines = ["{broken", event("gone", "1", "Following", {}, 1, 0, "tree-a", "other")]
    for r in built.nodes.filter("expansion_status = 'pending'").collect():
        for page in {p for s, p, *_ in rows if s == r["account_id"]}:
            users = [{"__typename": "User", "rest_id": t, "core": {"screen_name": "u" + t}, "relationship_counts": {"followers": f, "following": int(t)}} for s, p, _, t, f in rows if s == r["account_id"] and p == page]
            lines.append(event(f"e{r['account_id']}-{page}", r["account_id"], "Following", {"x": users}, page, r["first_depth"], r["tree_id"]))
    tasks, starts = spark.createDataFrame([("t",)], "task_id string"), seeds.withColumn("task_id", F.lit("t"))
    store = streamed(spark, tmp_path, lambda m, store: graph_state.start(m, store, tasks, starts), lines, rng)
    own = graph_state.GraphTables(store).graph("t", seeds, 3, 100)
    graphs_equal(own, built)
    declared = {r["account_id"]: r["declared_following"] for r in own.nodes.collect()}
    asked = {json.loads(x)["account_id"] for x in lines[2:]}
    found = {r["account_id"] for r in built.observations.collect()}
    assert declared == {a: int(a) if a in asked and a in found else None for a in declared}


def test_posts_and_metrics_of_a_stream_are_those_of_all_posts(spark, tmp_path):
    rng = random.Random(9)
    lines, best = [], {}
    for page in range(24):
        account, when = f"a{page % 3}", rng.randrange(50)
        entries = []
        for i in range(5):
            post, kind = str(rng.randrange(40)), rng.choice(["original", "quote", "reply", "retweet"])
            counts = [rng.randrange(50) for _ in range(5)]
            views = rng.choice([None, rng.randrange(1000)])
            day = rng.choice([None, rng.randrange(1, 28)])
            legacy = {"full_text": "x", "user_id_str": account, "reply_count": counts[0], "retweet_count": counts[1], "favorite_count": counts[2], "quote_count": counts[3], "bookmark_count": counts[4]}
            legacy |= {"original": {}, "quote": {"is_quote_status": True}, "reply": {"in_reply_to_status_id_str": "1"}, "retweet": {"retweeted_status_id_str": "1"}}[kind]
            if day:
                legacy["created_at"] = f"Sat Jan {day:02} 04:35:55 +0000 2025"
            result = {"__typename": "Tweet", "rest_id": post, "legacy": legacy, "views": {} if views is None else {"count": str(views)}}
            entries.append({"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}}}})
            place, row = (when, f"p{page:02}", i), ("t", account, post, kind, kind in ("original", "quote"), f"2025-01-{day:02} 04:35:55" if day else None, *counts, views)
            if (account, post) not in best or place < best[account, post][0]:
                best[account, post] = (place, row)
        lines.append(event(f"p{page:02}", account, "UserTweets", {"i": [{"type": "TimelineAddEntries", "entries": entries}]}, when))
    tasks = spark.createDataFrame([("t",)], "task_id string")
    store = streamed(spark, tmp_path, lambda m, store: post_state.start(m, store, tasks, target_posts=4), lines, rng)
    own = post_state.TimelineTables(store)
    names = "task_id string, account_id string, post_id string, kind string, is_qualifying boolean, posted string, reply_count int, retweet_count int, like_count int, quote_count int, bookmark_count int, view_count int"
    posts = spark.createDataFrame([row for _, row in best.values()], names).withColumn("posted_at", F.col("posted").cast("timestamp")).drop("posted")
    shown = [c for c in posts.columns if c != "posted_at"] + ["posted_at"]
    assert told(own.stored_posts(), *shown) == told(posts, *shown)
    profiles = spark.createDataFrame([("t", "a0", 100), ("t", "a1", 0)], "task_id string, account_id string, followers_count int")
    close = lambda df: [[round(v, 9) if isinstance(v, float) else v for v in r] for r in df.orderBy("account_id").collect()]
    assert close(own.account_metrics(profiles)) == close(metrics.account_metrics(posts, profiles, 4))


def test_metrics_of_stored_facts_have_all_counts(spark, tmp_path):
    """One page, then a later version of its post that comes first: the first version in the order of events counts."""
    def page(name, likes, when):
        legacy = {"full_text": "x", "user_id_str": "a", "reply_count": 5, "retweet_count": 6, "favorite_count": likes, "bookmark_count": 3}
        result = {"__typename": "Tweet", "rest_id": "9", "legacy": legacy, "views": {"count": "100"}}
        return event(name, "a", "UserTweets", {"i": [{"type": "TimelineAddEntries", "entries": [{"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}}}}]}]}, when)

    store, tasks = ingest.Store(spark, str(tmp_path)), spark.createDataFrame([("t",)], "task_id string")
    user = lambda name: {"__typename": "User", "rest_id": "a", "core": {"screen_name": name}, "relationship_counts": {"followers": 50}}
    put = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    ingest.apply_batch(store, tasks)(put(page("z", 99, 40), event("y", "b", "Following", {"x": [user("new")]}, 30, 1)), 0)
    ingest.apply_batch(store, tasks)(put(page("e", 10, 20), event("w", "b", "Following", {"x": [user("old")]}, 10, 1)), 1)
    row = tables.metrics(store).head()
    assert (row["avg_reply"], row["avg_retweet"], row["median_engagement"], row["engagement_rate"], row["bookmark_rate"], row["reach_ratio"]) == (5, 6, 21, 0.21, 0.03, 2)
    assert tables.profiles(store).head()["username"] == "new"


def test_medians():
    for values in ([], [3], [1, 4], [5, 1, 2], [1, 2, 2, 9]):
        ordered = sorted(values)
        n = len(ordered)
        exact = None if not n else (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert post_state.median(values) == exact




def test_offsets_by_topic_and_partition(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    assert ingest.offsets(store).count() == 0
    for folder in ("offsets", "commits"):
        (tmp_path / "parser/checkpoint" / folder).mkdir(parents=True)
    for batch, (a, b) in enumerate([(5, 0), (9, 4), (12, 4)]):
        (tmp_path / f"parser/checkpoint/offsets/{batch}").write_text(f'v1\n{{"batchWatermarkMs":0}}\n{{"raw":{{"0":{a},"1":{b}}}}}\n{{"logOffset":{batch}}}')
    for batch in range(2):
        (tmp_path / f"parser/checkpoint/commits/{batch}").write_text('v1\n{"nextBatchWatermarkMs":0}')
    got = {(r["source"], r["topic"], r["partition"]): (r["batch"], r["committed"], r["planned"], r["ahead"]) for r in ingest.offsets(store).collect()}
    assert got == {(0, "raw", 0): (1, 9, 12, 3), (0, "raw", 1): (1, 4, 4, 0), (1, None, None): (1, 1, 2, 1)}
