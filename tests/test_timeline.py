import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fernweave.operators import admission, chains, metrics, records, tasks
from fernweave.schemas import empty
from tests.graphs import T, listed, made, table

COLUMNS = ["account_id", "post_id", "kind", "is_qualifying", "posted_at", "reply_count", "retweet_count", "like_count", "quote_count", "bookmark_count", "view_count"]


def post(i, kind, likes=100, views=1000, age=0, account="a"):
    quiet = kind == "retweet"
    return (account, f"p{i:03d}", kind, kind in ("original", "quote"), datetime(2026, 1, 30) - timedelta(days=age), *([0] * 5 if quiet else [3, 7, likes, 1, 5]), None if quiet else views)


def conformed_rows(spark, name, columns, rows):
    return table(spark, name, [dict(zip(columns, r, strict=True)) for r in rows]) if rows else empty(spark, name)


def measured(spark, posts, followers=1000, target=30):
    frame = conformed_rows(spark, "account_posts", COLUMNS, posts)
    profiles = table(spark, "account_profiles", [{"account_id": "a", "followers_count": followers}])
    return {r["account_id"]: r for r in metrics.account_metrics(frame, profiles, target).collect()}


def test_reposts_do_not_count(spark):
    m = measured(spark, [post(i, "retweet") for i in range(6)] + [post(6, "reply"), post(7, "original", 1000), post(8, "quote", 500)])["a"]
    assert (m["sample_count"], m["scanned_count"], m["avg_like"]) == (2, 9, 750.0)


def test_missing_views_are_not_zero(spark):
    m = measured(spark, [post(i, "original", views=v) for i, v in enumerate((2000, None, 4000))])["a"]
    assert (m["sample_count"], m["view_sample_count"], m["avg_view"], m["reach_ratio"]) == (3, 2, 3000.0, 3.0)
    assert m["engagement_rate"] == pytest.approx(220 / 6000) and m["median_engagement"] == 110.0


def test_newest_posts_make_the_sample(spark):
    m = measured(spark, [post(i, "original", age=i) for i in range(12)], target=5)["a"]
    assert (m["sample_count"], m["sample_span_days"], m["scanned_count"]) == (5, 4.0, 12)
    again = measured(spark, [post(i, "original", age=i) for i in reversed(range(12))], target=5)["a"]
    assert again == m


def test_account_without_sample(spark):
    m = measured(spark, [post(1, "retweet")], followers=0)["a"]
    assert (m["sample_count"], m["view_sample_count"], m["avg_like"], m["reach_ratio"]) == (0, 0, None, None)
    assert measured(spark, []) == {}


@pytest.mark.parametrize(
    ("policy", "test"),
    [
        ({"require_can_dm": True, "min_followers": 300}, lambda r: r["can_dm"] and not r["protected"] and (r["followers_count"] or 0) >= 300),
        ({"exclude_protected": False, "max_depth": 1}, lambda r: r["first_depth"] <= 1),
        ({"bio_keywords": ("maps", "fan"), "max_followers": 5600}, lambda r: not r["protected"] and r["description"] and r["followers_count"] is not None and r["followers_count"] <= 5600),
        ({"min_network_indegree": 3, "min_discovery_paths": 4}, lambda r: not r["protected"] and r["degree"] >= 3 and r["paths"] >= 4),
    ],
)
def test_admission_by_brute_force(spark, policy, test):
    frames, plain = made(spark)
    rows = listed(plain)
    for i, r in rows.items():
        r |= {"degree": sum(e["target_account_id"] == i for e in plain["follow_edges"]), "paths": sum(x["account_id"] == i for x in plain["account_observations"])}
    known = {p["account_id"] for p in plain["account_profiles"]}
    wanted = sorted((i for i, r in rows.items() if i in known and test(r)), key=lambda i: (-rows[i]["degree"], rows[i]["followers_count"] is None, -(rows[i]["followers_count"] or 0), i))
    chosen = admission.candidates(frames, T, admission.CandidatePolicy(**policy))
    assert [r["account_id"] for r in chosen.collect()] == wanted != []
    assert {tuple(r["candidate_reasons"]) for r in chosen.collect()} == {admission.CandidatePolicy(**policy).active_conditions()}
    after = admission.admitted(frames["account_nodes"], chosen, T)
    assert after.filter("timeline_status = 'queued'").count() == len(wanted) and after.count() == len(rows)
    assert admission.queued(frames["crawl_frontier"], chosen, T).count() == len(wanted)
    off = frames | {"crawl_tasks": frames["crawl_tasks"].withColumn("timeline_enabled", F.lit(False))}
    assert admission.candidates(off, T, admission.CandidatePolicy(**policy)).count() == 0


def test_admission_rules(spark):
    frames, _ = made(spark)
    with pytest.raises(LookupError):
        admission.candidates(frames, "other", admission.CandidatePolicy())
    with pytest.raises(ValueError):
        admission.CandidatePolicy(min_followers=2, max_followers=1)
    assert admission.with_timeline_state(frames["account_nodes"], T, "acct05", "complete").filter("timeline_status = 'complete'").count() == 1


def outcome(spark, pages, **more):
    rows = [(T, "a", k, n, c) for k, (n, c) in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "task_id string, account_id string, page_no int, n_users int, cursor_out string")
    r = chains.expansion_outcomes(df, **more).head()
    return r["pages"], r["reason"]


def test_chain_endings(spark):
    assert outcome(spark, [(2, "a"), (0, "b"), (2, None)]) == (3, "natural_end")
    assert outcome(spark, [(2, "a"), (0, "b"), (0, "c"), (0, "d"), (9, "e")]) == (4, "empty_pages")
    assert outcome(spark, [(2, "a"), (2, "b"), (2, "a"), (2, None)]) == (3, "cursor_stalled")
    assert outcome(spark, [(2, "a"), (2, "b"), (2, "c")], max_pages=2) == (2, "page_limit")
    assert outcome(spark, [(2, "a"), (2, "b")]) == (2, None)


def test_timeline_endings(spark):
    rows = [(T, "a", k, 20, 20, q, f"c{k}") for k, q in enumerate((3, 4, 25, 1), 1)] + [(T, "b", k, 20, 20, 0, f"c{k}") for k in range(1, 9)]
    df = spark.createDataFrame(rows, "task_id string, account_id string, page_no int, n_posts int, n_own int, n_qualifying int, cursor_out string")
    got = {r["account_id"]: (r["pages"], r["reason"], r["scanned"], r["qualifying"]) for r in chains.timeline_outcomes(df, max_scanned=100).collect()}
    assert got == {"a": (3, "target_reached", 60, 32), "b": (5, "scan_limit", 100, 0)}


def test_upserts(spark):
    table_ = spark.createDataFrame([("a", 1)], "k string, v int")
    more = spark.createDataFrame([("a", 5, 1), ("b", 7, 2), ("b", 6, 1), (None, 1, 1)], "k string, v int, o int")
    assert sorted(map(tuple, records.first_wins(table_, more.drop("o"), ["k"], ["v"]).collect()), key=str) == [("a", 1), ("b", 6), (None, 1)]
    once = records.latest_wins(table_, more, ["k"], ["o"])
    assert {tuple(r) for r in once.collect()} == {("a", 5), ("b", 7), (None, 1)}
    assert {tuple(r) for r in records.latest_wins(once, more, ["k"], ["o"]).collect()} == {("a", 5), ("b", 7), (None, 1)}


def test_spent_items_fail(spark):
    frame = spark.createDataFrame([("a", "pending", 3, 3), ("b", "retryable", 2, 3), ("c", "complete", 5, 3), ("d", "retryable", 4, 3)], "id string, status string, attempt int, max_attempts int")
    assert {r["id"]: r["status"] for r in tasks.exhausted(frame).collect()} == {"a": "failed", "b": "retryable", "c": "complete", "d": "failed"}


def test_pages_are_recorded_with_what_depends_on_them(spark):
    frames = {
        "raw_page_outbox": spark.createDataFrame([(T, "e0", "old")], "task_id string, event_id string, payload string"),
        "crawl_tasks": spark.createDataFrame([(T, 5)], "task_id string, pages_produced int"),
        "crawl_frontier": spark.createDataFrame([(1, "w", "c0"), (2, None, None)], "frontier_id long, owner_id string, cursor_in string"),
        "request_attempts": spark.createDataFrame([("a1", "started"), ("a2", "failed"), ("a3", "started")], "attempt_id string, outcome string"),
    }
    columns = "task_id string, event_id string, payload string, frontier_id long, next_cursor string, owner string, attempt_id string, status_code int, received_at timestamp"
    at = [datetime(2026, 1, 1, 0, m) for m in range(5)]
    rows = [(T, "e0", "again", 1, "c9", "other", "a3", 200, at[4])]
    rows += [(T, "e1", "second", 1, "c8", "w", "a1", 200, at[2]), (T, "e1", "first", 1, "c1", "w", "a1", 200, at[0]), (T, "e2", "p", 1, "c2", "w", "a2", 200, at[1])]
    rows += [(T, "e3", "p", 2, "c3", "w", "a3", 200, at[3]), (T, "e4", "p", 2, None, "w", None, 200, at[3]), (T, "e5", "p", 7, "c5", None, None, 200, at[3]), (T, "e6", "p", None, None, None, None, None, None)]
    after = tasks.recorded(frames, spark.createDataFrame(rows, columns))
    told = lambda table, *names: {tuple(r) for r in after[table].select(*names).collect()}
    assert told("raw_page_outbox", "event_id", "payload") == {("e0", "old"), ("e1", "first"), ("e2", "p"), ("e4", "p"), ("e6", "p")}
    assert told("refused", "event_id") == {("e3",), ("e5",)}
    assert told("crawl_tasks", "pages_produced") == {(9,)}
    assert told("crawl_frontier", "frontier_id", "cursor_in") == {(1, "c2"), (2, None)}
    assert told("request_attempts", "attempt_id", "outcome", "status_code") == {("a1", "succeeded", 200), ("a2", "failed", None), ("a3", "started", None)}
    unchanged = tasks.recorded({**frames, "raw_page_outbox": after["raw_page_outbox"]}, spark.createDataFrame(rows, columns))
    assert unchanged["crawl_tasks"].head()["pages_produced"] == 5 and unchanged["refused"].count() == 2


def test_declared_numbers(spark):
    nodes = spark.createDataFrame([(T, i, n) for i, n in (("a", 1), ("b", 2), ("c", 3), ("d", None))], "task_id string, account_id string, declared_following int")
    told = spark.createDataFrame([(T, "a", 10), (T, "b", None), (T, "d", None)], "task_id string, account_id string, declared int")
    profiles = spark.createDataFrame([(T, "a", 99), (T, "b", 20), (T, "c", 30)], "task_id string, account_id string, following_count int")
    assert {r["account_id"]: r["declared_following"] for r in records.declared_following(nodes, told, profiles).collect()} == {"a": 10, "b": 20, "c": 3, "d": None}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_capacity_by_brute_force(spark, block):
    rng = random.Random(block)
    pages = [(t, k, rng.randrange(6), rng.randrange(9)) for t in "xyz" for k in rng.sample(range(200), 40)]
    room = {"x": (60, 900), "y": (900, 90)}
    limits = spark.createDataFrame([(t, n + 7, 7, e, 0) for t, (n, e) in room.items()], "task_id string, max_nodes int, nodes_created int, max_edges int, edges_created int")
    got = {(r["task_id"], r["page_order"]): r["fits"] for r in tasks.over_capacity(spark.createDataFrame(pages, "task_id string, page_order int, new_nodes int, new_edges int"), limits, block).collect()}
    for t in "xyz":
        n = e = 0
        for _, k, nodes, edges in sorted(p for p in pages if p[0] == t):
            fits = t not in room or nodes == edges == 0 or (n + nodes <= room[t][0] and e + edges <= room[t][1])
            n, e = n + nodes * fits, e + edges * fits  # a refused page takes nothing
            assert got[t, k] == fits
    assert len(got) == len(pages) and len(set(got.values())) == 2


@pytest.mark.parametrize(
    "wrong",
    [{"seeds": {}}, {"seeds": {"a": "1", "b": "1"}}, {"seeds": {"a": ""}}, {"task_id": ""}, {"max_depth": 6}, {"max_depth": -1}, {"max_nodes": 1}, {"budgets": {"Following": 0}}, {"budgets": {}}, {"max_edges": 0}],
)
def test_tasks_are_checked(wrong):
    with pytest.raises(ValueError):
        tasks.TaskSpec(**({"task_id": "new", "seeds": {"a": "1", "b": "2"}} | wrong))


def test_a_new_task(spark):
    new = tasks.created(spark, tasks.TaskSpec("new", {"a": "1", "b": "2"}, max_depth=0))
    assert {name: df.count() for name, df in new.items()} == {"crawl_tasks": 1, "task_operation_budgets": 2, "root_trees": 2, "account_nodes": 2, "crawl_frontier": 2}
    twice = tasks.added(new["root_trees"], new["root_trees"], ["task_id", "tree_id"])
    assert twice.count() == 2


def test_task_moves(spark):
    frame = spark.createDataFrame([("a", "running"), ("b", "completed"), ("c", "paused")], "task_id string, status string")
    moves = spark.createDataFrame([("a", "paused"), ("b", "running")], "task_id string, target string")
    assert {tuple(r) for r in tasks.moved(frame, moves).select("task_id", "status", "refused").collect()} == {("a", "paused", False), ("b", "completed", True), ("c", "paused", False)}
