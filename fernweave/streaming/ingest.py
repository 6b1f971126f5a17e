"""Pages from a stream into tables: each event applied once, whatever is delivered again, and nothing lost in silence.

A batch is decoded and split three ways: events to apply, events that were applied before, and dead letters. Which
events are new is the stream's own state (their keys, in RocksDB, kept in the checkpoint), so a batch looks up as many
keys as it has, however long the stream has run; the ledger is written for reports. Spark commits a batch after it was
written; if it fails in between, the batch comes again with the same number and the state of before, and its folder is
written over, so every table is a set of batches and none is applied twice. A group that starts with a new checkpoint
and a ledger of its own reads the stream from its beginning: that is how pages are parsed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernweave.functions.payload import walked
from fernweave.operators import parse
from fernweave.sources import events
from fernweave.streaming.manifest import Manifest

#: Names of groups and topics.
TOPIC, DEAD_TOPIC, PARSER = "raw-pages", "raw-pages-dlq", "parser"
DETAIL = 2000
LEDGER = "group_id string, task_id string, event_id string, batch bigint"
NEW = "__new"
#: Tasks that a stream may know for them to meet its messages by a broadcast.
MOST_TASKS = 1_000_000
#: Bytes of a file that a merge writes, as Parquet.
MERGED_FILE = 128 << 20
#: How the keys of events are kept: on the executors' disks, with the changes of each batch in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What a job shuffles goes when it ends; else it stays on the disks until the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, told: dict[str, str]) -> Iterator[None]:
    """told holds for what is run meanwhile, and for a stream that is started meanwhile as long as it runs."""
    conf = spark.conf
    before = {name: conf.get(name, None) for name in told}
    try:
        for name, value in told.items():
            conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def stateful(spark: SparkSession) -> AbstractContextManager[None]:
    """STATE and TIDY hold for the stream that is started meanwhile."""
    return settings(spark, STATE | TIDY)


def reparse_group(name: str, run: str) -> str:
    """The name of a group that reads everything again beside the one that is running."""
    if not run or not all(c.isalnum() or c in "-_" for c in run):
        raise ValueError("a run is named by letters, digits, - and _")
    return f"{name}-reparse-{run}"


def task_ids(tasks: DataFrame) -> DataFrame:
    """The ids of tasks, each once, broadcast: streams have no adaptive plans, and by a shuffle all messages of a task, payloads and all, would go to one task of Spark's."""
    ids = tasks.select("task_id").distinct()
    return F.broadcast(ids) if ids.limit(MOST_TASKS + 1).count() <= MOST_TASKS else ids


def delivered_once(messages: DataFrame) -> DataFrame:
    """messages (value) without those that came before, byte for byte: they say nothing new, and walking a page costs more than asking for its digest."""
    digest = F.unhex(F.sha2(F.col("value").cast("binary"), 256))
    return messages.select("value").withColumn("__digest", digest).dropDuplicates(["__digest"]).drop("__digest")


def with_news(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """The stream of messages and, in rows of their own, the keys of events that it delivers for the first time (`__new`).

    Only events that can be applied have keys here: one that comes before its task is there counts when it comes again.
    The state holds keys alone, no payloads; which delivery of a new key counts is settled within its batch.
    """
    rows = events.decoded(messages.select("value")).filter(F.col("problem").isNull())
    keys = rows.join(task_ids(tasks), "task_id", "left_semi").select("task_id", "event_id").dropDuplicates()
    told = messages.withColumn(NEW, F.lit(None).cast("struct<task_id:string,event_id:string>"))
    return told.unionByName(keys.select(F.struct("task_id", "event_id").alias(NEW)), allowMissingColumns=True)


def split(messages: DataFrame, tasks: DataFrame, ledger: DataFrame, group: str, news: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh events, duplicates, dead letters) of a batch.

    Dead letters: what can't be read, and events of tasks that aren't there. The first delivery of an event in a batch
    is the one that counts, by topic, partition and offset where messages have them. Fresh are the events whose keys are
    in news (task_id, event_id); without news, those that the group's ledger doesn't have. All of them are joined, not collected.
    """
    rows = events.decoded(messages)
    known = task_ids(tasks).select(F.col("task_id").alias("__task"))
    rows = rows.join(known, F.col("task_id") == F.col("__task"), "left")
    gone = F.col("problem").isNull() & F.col("__task").isNull()
    detail = F.left(F.coalesce("problem", F.concat(F.lit("task "), F.col("task_id"), F.lit(" is gone"))), F.lit(DETAIL))
    dead = rows.filter(F.col("problem").isNotNull() | gone)
    dead = dead.select("task_id", "event_id", F.when(F.col("problem").isNotNull(), "undecodable_event").otherwise("unknown_task").alias("error_class"), detail.alias("detail"), F.col("value").cast("string").alias("payload"))
    good = rows.filter(F.col("problem").isNull() & ~gone).drop("problem", "__task")
    delivered = [c for c in ("topic", "partition", "offset") if c in messages.columns]
    place = F.row_number().over(Window.partitionBy("task_id", "event_id").orderBy(*delivered, "received_at", F.xxhash64("value")))
    good = good.withColumn("__k", place)
    known = ledger.filter(F.col("group_id") == group) if news is None else news
    good = good.join(known.select("task_id", "event_id", F.lit(True).alias("__known")), ["task_id", "event_id"], "left")
    first = F.col("__known").isNull() if news is None else F.col("__known").isNotNull()
    again = ~first | (F.col("__k") > 1)
    return good.filter(~again).drop("__k", "__known"), good.filter(again).drop("__k", "__known"), dead


def routed(fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Following pages, UserTweets pages, dead letters): by operation; a Following page must say its depth."""
    following = fresh.filter((F.col("operation") == "Following") & F.col("depth").isNotNull())
    tweets = fresh.filter(F.col("operation") == "UserTweets")
    rest = fresh.filter(~F.col("operation").isin("Following", "UserTweets") | ((F.col("operation") == "Following") & F.col("depth").isNull()))
    why = F.when(F.col("operation") == "Following", "a Following page without a depth cannot be placed").otherwise(F.concat(F.lit("no handler for "), F.col("operation")))
    return following, tweets, rest.select("task_id", "event_id", F.lit("permanent_parse_error").alias("error_class"), why.alias("detail"), "payload")


class Store:
    """Tables under a folder, each a set of batches; a batch that comes again is written over.

    Batches that the stream has committed never come again, so their folders are merged: `fan` of a level into one of the
    next, so a table of n batches is read from fan * log(n) folders at most and a row is rewritten once a level. Merged
    rows carry the number of their batch. A manifest names the merged folders and the last batch in them; it is swapped
    when a merge is complete, and folders that only the manifest before it names are deleted by the merge after.
    """

    def __init__(self, spark: SparkSession, path: str, group: str = PARSER, fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("fan is 2 or more")
        self.spark, self.path, self.group, self.fan = spark, f"{path}/{group}", group, fan

    def put(self, df: DataFrame, table: str, batch: int) -> None:
        """Write a batch of a table; one that was merged is refused, since no reader would see it."""
        if batch <= self.manifest(table).read()["last"]:
            raise ValueError(f"batch {batch} of {table} was committed and merged before")
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def manifest(self, table: str) -> Manifest:
        """merged: folders (name, level, first and last batch); last: the last batch that is in one of them."""
        return Manifest(self.spark, f"{self.path}/{table}", {"merged": [], "last": -1})

    def folders(self, table: str) -> tuple[list[str], list[int]]:
        """The merged folders of a table and the batches that are in none of them."""
        manifest = self.manifest(table)
        told = manifest.read()
        loose = sorted(int(n.removeprefix("batch=")) for n in manifest.names("") if n.startswith("batch="))
        return [m["name"] for m in told["merged"]], [b for b in loose if b > told["last"]]

    def _rows(self, table: str, schema: str, merged: list[str], loose: list[int]) -> DataFrame:
        names = f"{schema}, batch bigint" if "batch bigint" not in schema else schema
        place, read = f"{self.path}/{table}", lambda: self.spark.read.schema(names)
        parts = [read().parquet(*[f"{place}/{name}" for name in merged])] if merged else []
        parts += [read().option("basePath", place).parquet(*[f"{place}/batch={b}" for b in loose])] if loose else []
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], names)

    def get(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of a table, of batches before a number if one is given; none if nothing was written yet."""
        merged, loose = self.folders(table)
        rows = self._rows(table, schema, merged, loose if before is None else [b for b in loose if b < before])
        return rows if before is None else rows.filter(F.col("batch") < before)

    def merge(self, table: str, schema: str, before: int) -> None:
        """Merge what is due of a table, of batches before a number: those that the stream has committed."""
        manifest = self.manifest(table)
        told = manifest.read()
        loose = [b for b in self.folders(table)[1] if b < before]
        if len(loose) < self.fan:
            return
        merged, last, kept = list(told["merged"]), told["last"], {m["name"] for m in told["merged"]}
        while len(loose) >= self.fan:
            # a step at once takes what its levels will take: merging by levels one after the other would write rows twice
            take, loose, level, joined = loose[: self.fan], loose[self.fan :], 1, []
            while len(full := [m for m in merged if m["level"] == level]) == self.fan - 1:
                joined, level = full + joined, level + 1
                merged = [m for m in merged if m not in full]
            first, last = joined[0]["first"] if joined else take[0], take[-1]
            into = {"name": f"merged{level}x{first}x{last}", "level": level, "first": first, "last": last}
            rows = self._rows(table, schema, [m["name"] for m in joined], take)
            size = sum(manifest.files().getContentSummary(manifest.at(n)).getLength() for n in [*[m["name"] for m in joined], *[f"batch={b}" for b in take]])
            rows.coalesce(max(1, size // MERGED_FILE)).write.mode("overwrite").parquet(f"{self.path}/{table}/{into['name']}")
            merged.append(into)
        manifest.swap({"version": told["version"] + 1, "merged": merged, "last": last})
        kept |= {m["name"] for m in merged}
        for name in manifest.names(""):
            old = name.startswith("batch=") and int(name.removeprefix("batch=")) <= told["last"]
            if old or (name.startswith("merged") and name not in kept):
                manifest.delete(name)

    def merge_all(self, before: int) -> None:
        for table, schema in STORED.items():
            self.merge(table, schema, before)

    def ledger(self, before: int | None = None) -> DataFrame:
        return self.get("ledger", LEDGER, before)


EDGE_ROWS = "task_id string, tree_id string, source string, depth int, event_id string, position bigint, target string, followers int"
PROFILES = (
    "task_id string, event_id string, at timestamp, position bigint, account_id string, username string, display_name string, description string, location string, followers_count int, following_count int, "
    "created_at timestamp, protected boolean, verified boolean, blue_verified boolean, can_dm boolean"
)
POSTS = (
    "task_id string, account_id string, event_id string, at timestamp, post_id string, kind string, is_qualifying boolean, text string, posted_at timestamp, reply_count int, retweet_count int, like_count int, quote_count int, "
    "bookmark_count int, view_count int, conversation_id string, in_reply_to_tweet_id string, quoted_tweet_id string, retweeted_tweet_id string"
)
DEAD = "task_id string, event_id string, error_class string, detail string, payload string"
STORED = {"listed": EDGE_ROWS, "profiles": PROFILES, "posts": POSTS, "dead": DEAD, "ledger": LEDGER}


def columns(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


def apply_batch(store: Store, tasks: DataFrame) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch, of messages with_news; of plain messages it asks the ledger, which it reads whole."""

    def run(rows: DataFrame, batch: int) -> None:
        kept: list[DataFrame] = []

        def held(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        rows = held(rows)
        try:
            if NEW in rows.columns:
                news = rows.filter(F.col(NEW).isNotNull()).select(f"{NEW}.*")
                fresh, _, dead = split(rows.filter(F.col(NEW).isNull()).drop(NEW), tasks, news, store.group, news)
            else:
                fresh, _, dead = split(rows, tasks, store.ledger(batch), store.group)
            # five tables follow from the fresh events and two from their users: neither is worked out for each of them
            fresh = held(fresh)
            following, tweets, unroutable = routed(fresh)
            keys = ["task_id", "tree_id", "source", "depth", "event_id", "at"]
            found = parse.users(following.withColumns({"source": F.col("account_id"), "at": F.col("requested_at")}).select(*keys, "payload"), keys)
            found = held(found.select("tree_id", "source", "depth", *columns(PROFILES)))
            listed = found.filter(F.col("account_id") != F.col("source"))
            store.put(listed.select("task_id", "tree_id", "source", "depth", "event_id", "position", F.col("account_id").alias("target"), F.col("followers_count").alias("followers")), "listed", batch)
            store.put(found.select(*columns(PROFILES)), "profiles", batch)
            keys = ["task_id", "account_id", "event_id", "at"]
            posts = parse.own_posts(parse.posts(tweets.select(*keys[:3], F.col("requested_at").alias("at"), "payload"), keys))
            store.put(posts.select(*columns(POSTS)), "posts", batch)
            store.put(dead.unionByName(unroutable), "dead", batch)
            store.put(fresh.select(F.lit(store.group).alias("group_id"), "task_id", "event_id"), "ledger", batch)
            store.merge_all(batch)
        finally:
            for df in reversed(kept):
                df.unpersist()

    return run


def start(messages: DataFrame, store: Store, tasks: DataFrame, once: bool = True) -> StreamingQuery:
    """The stream of messages (value) into a store; the checkpoint lies beside the store's tables, so both move together."""
    writer = with_news(messages, tasks).writeStream.foreachBatch(apply_batch(store, tasks)).option("checkpointLocation", f"{store.path}/checkpoint")
    with stateful(store.spark):
        return (writer.trigger(availableNow=True) if once else writer).start()


def stream_stats(store: Store, tasks: DataFrame) -> DataFrame:
    """Per task: events applied (dead letters that belong to a task among them) and dead letters by class."""
    applied = store.ledger().groupBy("task_id").agg(F.count(F.lit(1)).alias("pages_processed"))
    dead = store.get("dead", DEAD).filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.count(F.lit(1)).alias("dlq_events"))
    rows = tasks.select("task_id").join(applied, "task_id", "left").join(dead, "task_id", "left")
    return rows.select("task_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("pages_processed", "dlq_events")])


def offsets(store: Store, checkpoint: str = "checkpoint") -> DataFrame:
    """How far a stream is: for each source, topic and partition the offset that is committed, and what is planned beyond it.

    Read from the stream's own log: a batch's offsets are written before it runs, and it is committed when it has run. A
    source without topics (files) has its own counter as its only offset. No row where the stream has planned nothing yet.
    """
    names = "group_id string, batch bigint, source int, topic string, partition int, committed bigint, planned bigint, ahead bigint"
    spark = store.spark
    try:
        told = spark.read.text(f"{store.path}/{checkpoint}/offsets", wholetext=True).select("value", F.col("_metadata.file_name").cast("bigint").alias("batch"))
        done = spark.read.text(f"{store.path}/{checkpoint}/commits", wholetext=True).select(F.max(F.col("_metadata.file_name").cast("bigint")).alias("done"))
        last = done.first()["done"]
    except Exception as error:  # noqa: BLE001 - only a stream that hasn't begun is expected
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], names)
    # a version, a line about the batch, a line for each source
    lines = told.select("batch", F.posexplode(F.split("value", "\n")).alias("line", "value")).filter((F.col("line") >= 2) & F.col("value").startswith("{"))
    topics = F.from_json("value", "map<string,map<string,bigint>>")
    by_topic = F.flatten(F.transform(F.map_entries(topics), lambda t: F.transform(F.map_entries(t["value"]), lambda p: F.struct(t["key"].alias("topic"), p["key"].cast("int").alias("partition"), p["value"].alias("offset")))))
    own = F.array(F.struct(F.lit(None).cast("string").alias("topic"), F.lit(None).cast("int").alias("partition"), F.get_json_object("value", "$.logOffset").cast("bigint").alias("offset")))
    counter = F.get_json_object("value", "$.logOffset").isNotNull()
    rows = lines.select("batch", (F.col("line") - 2).alias("source"), F.explode(F.when(counter, own).otherwise(by_topic)).alias("o")).select("batch", "source", "o.*")
    at = lambda on: F.max_by(F.when(on, F.col("offset")), F.when(on, F.col("batch")))
    newest = rows.groupBy("source", "topic", "partition").agg(at(F.col("batch") <= F.lit(last)).alias("committed"), at(F.lit(True)).alias("planned"))
    batch = F.lit(last).cast("bigint").alias("batch")
    return newest.select(F.lit(store.group).alias("group_id"), batch, "source", "topic", "partition", "committed", "planned", (F.col("planned") - F.coalesce("committed", F.lit(0))).alias("ahead"))


__all__ = ["Store", "apply_batch", "offsets", "reparse_group", "routed", "split", "start", "stream_stats", "walked", "with_news"]
