"""Posts and metrics of accounts, kept by key as timeline pages come: a batch recomputes the accounts whose posts it holds.

An account's state has each of its posts once, the version of the earliest page (by time and id of the page, then by place),
and a sample: its newest qualifying posts, SAMPLE of them at most, as a bounded sorted list. New posts are merged into the sample,
which is enough, since what once fell out can't come back: unless an earlier version of a post in a full sample comes
late; then the sample is taken anew from the account's posts. Metrics are derived from the sample and a count, never added
to, so pages that come again, or in another order, end in the same rows as one pass over all posts.

What is emitted are changes, upserted by key: posts that are new or were replaced, and the metrics of accounts that changed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fernweave.operators import parse
from fernweave.operators.metrics import TARGET_POSTS
from fernweave.sources import events
from fernweave.streaming.ingest import Store, columns, delivered_once, stateful, task_ids
from fernweave.streaming.keyed import KeyedTable

COUNTS = ("reply_count", "retweet_count", "like_count", "quote_count", "bookmark_count", "view_count")
_NUMBERS = ", ".join(f"{c} int" for c in COUNTS)
PLACE = "at string, event string, ord long, item int"
#: Posts of an account that are kept together in its state: each question to the state costs more than such a part.
PART = 64
#: What the sample needs of a post; posted in microseconds.
SHORT = f"post_id string, is_qualifying boolean, posted bigint, {_NUMBERS}"
POSTS = f"task_id string, account_id string, post_id string, kind string, is_qualifying boolean, text string, posted_at timestamp, {_NUMBERS}, conversation_id string, in_reply_to_tweet_id string, quoted_tweet_id string, retweeted_tweet_id string"
METRICS = "sample_count bigint, scanned_count bigint, sample_span_days double, latest_post_at timestamp, avg_reply double, avg_retweet double, avg_like double, avg_view double, view_sample_count bigint, median_engagement double, engagement_rate double, bookmark_rate double"
_KEPT = f"{POSTS}, {PLACE}"
#: A post on its way through the state: its time as a number.
MOVED = _KEPT.replace("posted_at timestamp", "posted bigint")
#: What is told of a post beside its account: JSON while it goes through the state, since there each column of a row costs as much as all of it so.
TOLD = MOVED.removeprefix("task_id string, account_id string, ")
CHANGES = f"row string, task_id string, account_id string, told string, {METRICS}"
#: Where the stream's checkpoint and tables are under its store: a state of another layout needs a folder of its own.
FOLDER = "timelines-packed"


def own_mentions(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every mention of an account's own posts on the timeline pages among messages (value)."""
    pages = events.decoded(delivered_once(messages)).filter(F.col("problem").isNull() & (F.col("operation") == "UserTweets")).join(task_ids(tasks), "task_id", "left_semi")
    keys = ["task_id", "account_id", "at", "event"]
    pages = pages.select("task_id", "account_id", F.coalesce(F.col("requested_at").cast("string"), F.lit("")).alias("at"), F.col("event_id").alias("event"), "payload")
    found = parse.own_posts(parse.mentions(pages, keys)).withColumns({"ord": F.col("o.ord"), "item": F.col("o.place"), "posted": F.unix_micros("posted_at")})
    return found.select(*columns(MOVED))


_PLACE_OF, _SHORT_OF = (itemgetter(*columns(told)) for told in (PLACE, SHORT))
_CHANGE = Row(*columns(CHANGES))


def newest_first(post: tuple) -> tuple:
    """The order of the sample: newest first, posts without a time last, equal ones by id."""
    return (post[2] is None, -(post[2] or 0), post[0])


def mean(values: list[int]) -> float | None:
    return sum(values) / len(values) if values else None


def median(values: list[int]) -> float | None:
    """As percentile 0.5: between the two middle ones if they are even in number."""
    if not values:
        return None
    values, half = sorted(values), (len(values) - 1) // 2
    return values[half] + (values[half + (len(values) + 1) % 2] - values[half]) * 0.5


def metrics_of(sample: list[tuple], scanned: int) -> dict:
    """The metrics of a sample (rows as SHORT)."""
    from datetime import UTC, datetime, timedelta

    posted = [p[2] for p in sample if p[2] is not None]
    reply, retweet, like, _, bookmark, view = ([p[3 + i] for p in sample] for i in range(6))
    engaged = [a + b + c for a, b, c in zip(reply, retweet, like, strict=True)]
    seen = [i for i, v in enumerate(view) if v is not None]
    views = sum(view[i] for i in seen)
    latest = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=max(posted)) if posted else None
    told = {"sample_count": len(sample), "scanned_count": scanned, "sample_span_days": (max(posted) - min(posted)) / 86_400_000_000 if posted else None, "latest_post_at": latest}
    told |= {"avg_reply": mean(reply), "avg_retweet": mean(retweet), "avg_like": mean(like), "avg_view": mean([view[i] for i in seen]), "view_sample_count": len(seen), "median_engagement": median(engaged)}
    return told | {"engagement_rate": sum(engaged[i] for i in seen) / views if views else None, "bookmark_rate": sum(bookmark[i] for i in seen) / views if views else None}


def part_of(post_id: str, parts: int) -> int:
    return zlib.crc32(post_id.encode()) % parts


def packed(told: object) -> bytes:
    """JSON, compressed: the posts of an account say much the same, and what a batch changes in a state is written three times."""
    return zlib.compress(json.dumps(told, separators=(",", ":")).encode(), 1)


def unpacked(raw: bytes) -> Any:
    return json.loads(zlib.decompress(raw))


class Timelines(StatefulProcessor):
    """The state of (task, account): its posts by parts of some PART, dealt by a hash of the id, its sample, the number of posts."""

    def __init__(self, target_posts: int = TARGET_POSTS) -> None:
        self.most = target_posts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "scanned bigint, parts int, sample binary")
        self.held = handle.getMapState("held", "part int", "posts binary")

    def _part(self, part: int) -> dict[str, list]:
        found = self.held.getValue((part,))
        return unpacked(found[0]) if found else {}

    def _deal(self, parts: int) -> None:
        """The posts into so many parts: as posts double each time, a post is dealt anew once or twice in the mean."""
        every = [post for posts in self.held.values() for post in unpacked(posts[0]).items()]
        dealt: dict[int, dict] = {}
        for post_id, told in every:
            dealt.setdefault(part_of(post_id, parts), {})[post_id] = told
        self.held.clear()
        for part, posts in dealt.items():
            self.held.updateValue((part,), (packed(posts),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:  # noqa: N802
        best: dict[str, tuple] = {}
        for row in rows:
            post = json.loads(row.told)
            post_id, place = post["post_id"], _PLACE_OF(post)
            if post_id not in best or place < best[post_id][0]:
                best[post_id] = (place, _SHORT_OF(post), row.told)
        before = self.account.get()
        scanned, parts = before[:2] if before else (0, 1)
        sample = [tuple(p) for p in unpacked(before[2])] if before else []
        full, held = len(sample) >= self.most, {p[0] for p in sample}
        wanted: dict[int, list[str]] = {}
        for post_id in best:
            wanted.setdefault(part_of(post_id, parts), []).append(post_id)
        changed, anew = [], False
        for part, ids in wanted.items():
            posts, so_far = self._part(part) if before else {}, len(changed)
            for post_id in ids:
                place, short, told = best[post_id]
                known = posts.get(post_id)
                if known is not None and tuple(known[:4]) <= place:
                    continue
                posts[post_id] = [*place, *short[1:]]
                changed.append(told)
                scanned += known is None
                if post_id in held:
                    anew = anew or full
                    sample = [p for p in sample if p[0] != post_id]
                if short[1]:
                    sample.append(short)
            if len(changed) > so_far:
                self.held.updateValue((part,), (packed(posts),))
        if not changed:
            return
        if anew:
            sample = [p for p in ((i, *v[4:]) for posts in self.held.values() for i, v in unpacked(posts[0]).items()) if p[1]]
        sample = sorted(sample, key=newest_first)[: self.most]
        if scanned > 2 * PART * parts:
            parts = scanned // PART
            self._deal(parts)
        self.account.update((scanned, parts, packed(sample)))
        nothing = (None,) * len(columns(METRICS))
        for told in changed:
            yield _CHANGE("post", *key, told, *nothing)
        found = metrics_of(sample, scanned)
        yield _CHANGE("metrics", *key, None, *[found[c] for c in columns(METRICS)])

    def close(self) -> None:
        pass


class TimelineTables:
    """The stored posts and metrics of a stream."""

    def __init__(self, store: Store) -> None:
        self.posts = KeyedTable(store.spark, f"{store.path}/{FOLDER}/posts", _KEPT, ["task_id", "account_id", "post_id"], columns(PLACE), "first")
        self.metrics = KeyedTable(store.spark, f"{store.path}/{FOLDER}/metrics", f"task_id string, account_id string, {METRICS}", ["task_id", "account_id"])

    def apply(self) -> Callable[[DataFrame, int], None]:
        def run(changes: DataFrame, batch: int) -> None:
            changes = changes.persist()
            try:
                self.posts.upsert(changes.filter("row = 'post'").withColumn("posted_at", F.timestamp_micros("posted")), batch)
                self.metrics.upsert(changes.filter("row = 'metrics'"), batch)
            finally:
                changes.unpersist()

        return run

    def stored_posts(self) -> DataFrame:
        return self.posts.read().select(*columns(POSTS))

    def account_metrics(self, profiles: DataFrame) -> DataFrame:
        """The metrics with reach, which depends on the followers that profiles (task_id, account_id, followers_count) tell."""
        keys = ["task_id", "account_id"]
        rows = self.metrics.read().join(profiles.select(*keys, "followers_count"), keys, "left")
        reach = F.col("avg_view") / F.nullif("followers_count", F.lit(0))
        ordered = [c for c in columns(METRICS) if c != "bookmark_rate"]
        return rows.select(*keys, *ordered, reach.alias("reach_ratio"), "bookmark_rate")


def start(messages: DataFrame, store: Store, tasks: DataFrame, once: bool = True, target_posts: int = TARGET_POSTS) -> StreamingQuery:
    """The stream of messages (value) into the store's posts and metrics."""
    with stateful(store.spark):
        told = F.to_json(F.struct(*columns(TOLD)), {"ignoreNullFields": "false"}).alias("told")
        rows = own_mentions(messages, tasks).select("task_id", "account_id", told).groupBy("task_id", "account_id")
        changes = rows.transformWithState(Timelines(target_posts), CHANGES, "Append", "None")
        changes = changes.withColumn("told", F.from_json("told", TOLD)).select("row", "task_id", "account_id", "told.*", *columns(METRICS))
        writer = changes.writeStream.foreachBatch(TimelineTables(store).apply()).outputMode("append").option("checkpointLocation", f"{store.path}/{FOLDER}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()
