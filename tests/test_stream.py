import json

import pytest

from fernweave.sources import events
from fernweave.streaming import ingest, tables


def message(i, task="t", op="Following", depth=1, payload=None):
    users = [{"__typename": "User", "rest_id": r, "core": {"screen_name": "u" + r}} for r in ("1", "2")]
    return json.dumps({"event_id": i, "task_id": task, "account_id": "a", "operation": op, "depth": depth, "tree_id": "tree-a", "payload": payload or {"x": users}})


def run(spark, path, group="parser"):
    store = ingest.Store(spark, str(path), group)
    tasks = spark.createDataFrame([("t",)], "task_id string")
    ingest.start(events.from_files(spark, f"{path}/in", 1).select("value"), store, tasks).awaitTermination()
    return store, tasks


def put(path, name, *lines):
    (path / "in").mkdir(exist_ok=True)
    (path / "in" / name).write_text("\n".join(lines) + "\n")


def test_each_event_counts_once(spark, tmp_path):
    put(tmp_path, "a.txt", message("e1"), message("e1"), message("e2", op="UserByScreenName"), "{broken", message("e3", task="gone"), message("e4", depth=None))
    store, tasks = run(spark, tmp_path)
    listed = store.get("listed", ingest.EDGE_ROWS)
    assert {(r["target"], r["position"]) for r in listed.collect()} == {("1", 1), ("2", 2)}
    dead = {(r["error_class"], r["event_id"]) for r in store.get("dead", ingest.DEAD).collect()}
    assert dead == {("undecodable_event", None), ("unknown_task", "e3"), ("permanent_parse_error", "e2"), ("permanent_parse_error", "e4")}
    put(tmp_path, "b.txt", message("e1"), message("e5"))
    run(spark, tmp_path)
    assert store.get("listed", ingest.EDGE_ROWS).count() == 4 and store.ledger().count() == 4
    stats = ingest.stream_stats(store, tasks).head()
    assert (stats["pages_processed"], stats["dlq_events"]) == (4, 2)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    tasks = spark.createDataFrame([("t",)], "task_id string")
    batch = spark.createDataFrame([(message("e1"),), (message("e2"),)], "value string")
    for _ in range(2):
        ingest.apply_batch(store, tasks)(batch, 0)
    assert store.get("listed", ingest.EDGE_ROWS).count() == 4 and store.ledger().count() == 2
    ingest.apply_batch(store, tasks)(batch, 1)
    assert store.ledger().count() == 2


def test_a_batch_that_fails_before_its_ledger_is_written_comes_again(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.txt", message("e1"), message("e1"), message("e2"))
    whole, failed = ingest.Store.put, []

    def once(self, df, table, batch):
        if table == "ledger" and not failed:
            failed.append(batch)
            raise OSError("no room")
        whole(self, df, table, batch)

    monkeypatch.setattr(ingest.Store, "put", once)
    with pytest.raises(Exception, match="no room"):
        run(spark, tmp_path)
    store, _ = run(spark, tmp_path)
    assert store.get("listed", ingest.EDGE_ROWS).count() == 4 and store.ledger().count() == 2
    put(tmp_path, "b.txt", message("e2"), message("e3"))
    run(spark, tmp_path)
    assert sorted(r["event_id"] for r in store.ledger().collect()) == ["e1", "e2", "e3"]


def test_the_stream_asks_its_state_and_not_the_ledger(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.txt", message("e1"))
    run(spark, tmp_path)
    monkeypatch.setattr(ingest.Store, "ledger", lambda self, before=None: pytest.fail("the ledger is read"))
    put(tmp_path, "b.txt", message("e1"), message("e2"))
    store, _ = run(spark, tmp_path)
    assert store.get("listed", ingest.EDGE_ROWS).count() == 4


def test_an_event_counts_once_its_task_is_there(spark, tmp_path):
    put(tmp_path, "a.txt", message("e1", task="late"))
    run(spark, tmp_path)
    put(tmp_path, "b.txt", message("e1", task="late"))
    store = ingest.Store(spark, str(tmp_path))
    tasks = spark.createDataFrame([("t",), ("late",)], "task_id string")
    ingest.start(events.from_files(spark, f"{tmp_path}/in", 1).select("value"), store, tasks).awaitTermination()
    assert [r["event_id"] for r in store.ledger().collect()] == ["e1"]
    assert store.get("dead", ingest.DEAD).count() == 1


def test_the_first_delivery_counts(spark):
    rows = [(message("e1", payload={"n": k}), "raw-pages", part, offset) for k, (part, offset) in enumerate([(1, 5), (0, 9), (0, 3), (2, 0)])]
    batch = spark.createDataFrame(rows, "value string, topic string, partition int, offset long")
    tasks, none = spark.createDataFrame([("t",)], "task_id string"), spark.createDataFrame([], ingest.LEDGER)
    fresh, again, _ = ingest.split(batch, tasks, none, "parser")
    assert [json.loads(r["payload"]) for r in fresh.collect()] == [{"n": 2}] and again.count() == 3


def test_tables_of_a_replay_are_equal(spark, tmp_path):
    put(tmp_path, "a.txt", message("e1"), message("e2", depth=2))
    store, _ = run(spark, tmp_path)
    told = lambda: [sorted(map(str, f(store).collect())) for f in (tables.nodes, tables.edges, tables.profiles, tables.open_expansions)]
    before = told()
    put(tmp_path, "b.txt", message("e1"), message("e2", depth=2))
    run(spark, tmp_path)
    assert told() == before and len(before[0]) == 3 and len(before[1]) == 2
    other, _ = run(spark, tmp_path, "again")
    assert sorted(map(str, tables.nodes(other).collect())) == before[0]


def test_a_new_group_reads_everything_again(spark, tmp_path):
    put(tmp_path, "a.txt", message("e1"))
    run(spark, tmp_path)
    store, _ = run(spark, tmp_path, ingest.reparse_group("parser", "v2"))
    assert store.ledger().count() == 1
    with pytest.raises(ValueError):
        ingest.reparse_group("parser", "a/b")


def test_posts_of_timeline_pages(spark, tmp_path):
    tweet = {"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": {"__typename": "Tweet", "rest_id": "9", "legacy": {"full_text": "x", "user_id_str": "a"}}}}}}
    put(tmp_path, "a.txt", message("e1", op="UserTweets", payload={"i": [{"type": "TimelineAddEntries", "entries": [tweet]}]}))
    store, _ = run(spark, tmp_path)
    assert [r["post_id"] for r in store.get("posts", ingest.POSTS).collect()] == ["9"]
