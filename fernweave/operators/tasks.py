"""Tasks and their work: progress reports, states after a move, and what work is open, as reads over the tables.

Collection isn't done here, so nothing hands work to workers under locks. What there is, is the data side: which items
are open and in which order, and what a table is after a batch of outcomes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import cut
from fernweave.functions.rules import may_move
from fernweave.operators.layers import FOLLOWING


def task_list(tasks: DataFrame, trees: DataFrame, limit: int = 50) -> DataFrame:
    """Tasks, newest first, with their number of seeds."""
    seeds = trees.groupBy("task_id").agg(F.count(F.lit(1)).alias("seeds"))
    shown = ["task_id", "status", "current_depth", "max_depth", "timeline_enabled", "requests_attempted", "max_requests", "nodes_created", "edges_created", "pages_produced", "pages_processed", "created_at", "updated_at"]
    rows = tasks.select(*shown).join(seeds, "task_id", "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)).cast("bigint"))
    return rows.orderBy(F.col("created_at").desc(), "task_id").limit(limit)


def frontier_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("task_id", "operation", "status").agg(F.count(F.lit(1)).alias("n"))


def top_errors(frontier: DataFrame, task_id: str, limit: int = 10) -> DataFrame:
    failed = frontier.filter((F.col("task_id") == task_id) & F.col("last_error_class").isNotNull())
    return failed.groupBy(F.col("last_error_class").alias("error_class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "error_class").limit(limit)


def rate_limit_wait(frontier: DataFrame, as_of: str) -> DataFrame:
    """Per task: items that wait for a window, and when the first of them opens."""
    waiting = frontier.filter((F.col("status") == "retryable") & (F.col("not_before") > F.lit(as_of).cast("timestamp")))
    return waiting.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.min("not_before").alias("earliest"))


def moved(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """tasks after moves (task_id, target): status, and refused where the move isn't allowed."""
    rows = tasks.join(moves, "task_id", "left")
    asked = F.col("target").isNotNull()
    allowed = may_move(F.col("status"), F.col("target"))
    return rows.withColumns({"refused": asked & ~allowed, "status": F.when(asked & allowed, F.col("target")).otherwise(F.col("status"))}).drop("target")


def released(frontier: DataFrame, tasks: DataFrame) -> DataFrame:
    """frontier with the running items of paused and terminated tasks open again."""
    stopped = tasks.filter(F.col("status").isin("paused", "terminated")).select("task_id", F.lit(True).alias("__stopped"))
    free = F.coalesce("__stopped", F.lit(False)) & (F.col("status") == "running") & F.col("owner_id").isNotNull()
    rows = frontier.join(stopped, "task_id", "left").withColumn("__free", free)
    cleared = {"status": F.when(F.col("__free"), "pending").otherwise(F.col("status"))} | {c: F.when(~F.col("__free"), F.col(c)) for c in ("owner_id", "lease_expires_at")}
    return rows.withColumns(cleared).select(*frontier.columns)


def open_work(frontier: DataFrame, tasks: DataFrame, as_of: str, operation: str | None = None) -> DataFrame:
    """Items that may be worked on, first things first. Traversal keeps to its task's open layer, the rest doesn't."""
    now = F.lit(as_of).cast("timestamp")
    running = tasks.filter(F.col("status") == "running").select("task_id", "current_depth")
    items = frontier if operation is None else frontier.filter(F.col("operation") == operation)
    free = F.col("status").isin("pending", "retryable") | ((F.col("status") == "running") & (F.col("lease_expires_at") <= now))
    items = items.filter(free & (F.col("not_before") <= now) & (F.col("attempt") < F.col("max_attempts"))).join(running, "task_id")
    items = items.filter((F.col("operation") != FOLLOWING) | (F.col("depth") == F.col("current_depth"))).drop("current_depth")
    return items.orderBy(F.col("priority").desc(), "depth", "frontier_id")


def after_outcomes(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """frontier after outcomes (frontier_id, outcome, next_cursor, error_class, refund).

    An item to be tried again that has no attempts left has failed. A refund gives back the attempt of one that was
    never sent; a cursor that isn't given stays.
    """
    named = outcomes.select("frontier_id", *[F.col(c).alias(f"__{c}") for c in ("outcome", "next_cursor", "error_class", "refund")])
    rows = frontier.join(named, "frontier_id", "left")
    done = F.col("__outcome").isNotNull()
    attempt = F.when(done & F.coalesce("__refund", F.lit(False)), F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt"))
    spent = (F.col("__outcome") == "retryable") & (attempt >= F.col("max_attempts"))
    new = {
        "status": F.when(spent, "failed").otherwise(F.coalesce("__outcome", "status")),
        "attempt": attempt,
        "cursor_in": F.coalesce("__next_cursor", "cursor_in"),
        "last_error_class": F.when(done, F.col("__error_class")).otherwise(F.col("last_error_class")),
        "owner_id": F.when(~done, F.col("owner_id")),
        "lease_expires_at": F.when(~done, F.col("lease_expires_at")),
    }
    return rows.withColumns(new).select(*frontier.columns)


def exhausted(frontier: DataFrame) -> DataFrame:
    """frontier with items failed that are open but have no attempts left."""
    spent = F.col("status").isin("pending", "retryable") & (F.col("attempt") >= F.col("max_attempts"))
    return frontier.withColumn("status", F.when(spent, "failed").otherwise(F.col("status")))


def budgets_left(tasks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Requests that each operation of a task may still make: the lesser of its own budget's and the task's rest."""
    of_task = tasks.select("task_id", (F.col("max_requests") - F.col("requests_attempted")).alias("task_left"))
    own = budgets.withColumn("own_left", F.col("max_requests") - F.col("requests_attempted")).select("task_id", "operation", "own_left")
    return own.join(of_task, "task_id").select("task_id", "operation", F.greatest(F.lit(0), F.least("own_left", "task_left")).alias("left"))


def over_capacity(pages: DataFrame, tasks: DataFrame, block: int = 10_000) -> DataFrame:
    """pages (task_id, page_order, new_nodes, new_edges) with fits: false where the task's nodes or edges would overflow.

    Pages count in the order of their numbers, which differ within a task. A page that doesn't fit takes nothing, so a
    smaller one after it may still fit; one that brings nothing new always fits, as does one of a task without limits.

    Done in rounds, all tasks at once. Room only shrinks, so what exceeds what is left now will never fit and is refused;
    of the rest, all pages before the first at which the running sums overflow fit. A round costs sums by blocks of
    `block` numbers, added up before the shuffle, and the pages that are still open. After the first overflow less is
    left than one page wanted, so few pages can fit after that, and the rounds are few.
    """
    from pyspark.sql import Window

    number = ["__nodes", "__edges"]
    room = tasks.select("task_id", (F.col("max_nodes") - F.col("nodes_created")).alias("__nodes"), (F.col("max_edges") - F.col("edges_created")).alias("__edges"))
    rows = pages.withColumns({"__n": F.coalesce("new_nodes", F.lit(0)).cast("bigint"), "__e": F.coalesce("new_edges", F.lit(0)).cast("bigint")})
    known = rows.join(room, "task_id", "left").withColumn("__free", F.col("__nodes").isNull() | F.col("__edges").isNull() | ((F.col("__n") == 0) & (F.col("__e") == 0)))
    told = known.filter("__free").select(*pages.columns, F.lit(True).alias("fits"))
    open_pages = cut(known.filter("NOT __free").drop("__free", *number))
    while not open_pages.isEmpty():
        possible = open_pages.join(room, "task_id").withColumn("__can", (F.col("__n") <= F.col("__nodes")) & (F.col("__e") <= F.col("__edges")))
        told = told.unionByName(possible.filter("NOT __can").select(*pages.columns, F.lit(False).alias("fits")))
        left = possible.filter("__can").withColumn("__block", F.floor(F.col("page_order") / block))
        sums = left.groupBy("task_id", "__block").agg(F.sum("__n").alias("n"), F.sum("__e").alias("e"))
        earlier = Window.partitionBy("task_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("task_id", "__block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}0") for c in ("n", "e")])
        upto = Window.partitionBy("task_id", "__block").orderBy("page_order").rowsBetween(Window.unboundedPreceding, 0)
        summed = left.withColumns({"__sn": F.sum("__n").over(upto), "__se": F.sum("__e").over(upto)}).join(starts, ["task_id", "__block"])
        over = (F.col("__sn") + F.col("__n0") > F.col("__nodes")) | (F.col("__se") + F.col("__e0") > F.col("__edges"))
        summed = cut(summed.withColumn("__over", over).drop("__block", "__sn", "__se", "__n0", "__e0", *number))
        stop = summed.filter("__over").groupBy("task_id").agg(F.min("page_order").alias("__stop"))  # a row for each task
        placed = summed.join(stop, "task_id", "left").withColumn("__before", F.coalesce(F.col("page_order") < F.col("__stop"), F.lit(True)))
        told = told.unionByName(placed.filter("__before").select(*pages.columns, F.lit(True).alias("fits")))
        took = placed.filter("__before").groupBy("task_id").agg(F.sum("__n").alias("n"), F.sum("__e").alias("e"))
        fewer = room.join(took, "task_id", "left")
        room = cut(fewer.select("task_id", (F.col("__nodes") - F.coalesce("n", F.lit(0))).alias("__nodes"), (F.col("__edges") - F.coalesce("e", F.lit(0))).alias("__edges")))
        open_pages = cut(placed.filter("NOT __before").select(*pages.columns, "__n", "__e"))
    return told


def pipeline_stats(frames: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Per task: pages produced and processed, what waits to be published and for how long, and what was given up."""
    now = F.lit(as_of).cast("timestamp")
    waits = F.col("published_at").isNull() & F.col("dead_lettered_at").isNull()
    outbox = frames["raw_page_outbox"].groupBy("task_id").agg(
        F.count_if(waits).alias("outbox_pending"),
        F.count_if(F.col("dead_lettered_at").isNotNull()).alias("outbox_dead_lettered"),
        ((F.unix_micros(now) - F.unix_micros(F.min(F.when(waits, F.col("created_at"))))) / 1_000_000).alias("oldest_unpublished_seconds"),
    )
    dlq = frames["dlq_events"].filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.count(F.lit(1)).alias("dlq_events"))
    rows = frames["crawl_tasks"].select("task_id", "pages_produced", "pages_processed").join(outbox, "task_id", "left").join(dlq, "task_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("outbox_pending", "outbox_dead_lettered", "dlq_events")}
    backlog = F.col("pages_produced") - F.col("pages_processed")
    return rows.withColumns(counts | {"backlog": backlog, "drained": (backlog <= 0) & (F.coalesce("outbox_pending", F.lit(0)) == 0)})


def outbox_due(outbox: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    """The pages to publish next."""
    now = F.lit(as_of).cast("timestamp")
    due = F.col("published_at").isNull() & F.col("dead_lettered_at").isNull() & (F.col("not_before") <= now) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    return outbox.filter(due).orderBy("created_at", "task_id", "event_id").limit(limit)


def after_publishing(outbox: DataFrame, outcomes: DataFrame, as_of: str, backoff_s: int = 5, max_attempts: int = 5) -> DataFrame:
    """outbox after outcomes (task_id, event_id, error): published, put off, or given up after the last attempt."""
    now = F.lit(as_of).cast("timestamp")
    named = outcomes.select("task_id", "event_id", F.col("error").alias("__error"), F.lit(True).alias("__tried"))
    rows = outbox.join(named, ["task_id", "event_id"], "left")
    tried, failed = F.coalesce("__tried", F.lit(False)), F.col("__error").isNotNull()
    dead = tried & failed & (F.col("attempts") >= max_attempts)
    new = {
        "published_at": F.when(tried & ~failed, now).otherwise(F.col("published_at")),
        "dead_lettered_at": F.when(dead, now).otherwise(F.col("dead_lettered_at")),
        "not_before": F.when(tried & failed & ~dead, F.timestamp_micros(F.unix_micros(now) + backoff_s * 1_000_000)).otherwise(F.col("not_before")),
        "last_error": F.when(tried & failed, F.left("__error", F.lit(500))).otherwise(F.col("last_error")),
        "lease_expires_at": F.when(~tried, F.col("lease_expires_at")),
    }
    return rows.withColumns(new).select(*outbox.columns)


def recorded(frames: dict[str, DataFrame], pages: DataFrame) -> dict[str, DataFrame]:
    """raw_page_outbox, crawl_tasks, crawl_frontier and request_attempts after pages came in, and the pages `refused`.

    pages: columns of the outbox, and frontier_id, next_cursor, owner, attempt_id, status_code, received_at. A page that
    the outbox has changes nothing. One whose cursor can't be kept, since its item is gone or another owner's, is
    refused. All tables follow from one set of pages, written once: none tells of a page that another doesn't have. An
    item's cursor is that of its last page; of two deliveries of a page the first counts, by received_at.
    """
    key = ["task_id", "event_id"]
    outbox, frontier, attempts = frames["raw_page_outbox"], frames["crawl_frontier"], frames["request_attempts"]
    owners = frontier.select("frontier_id", F.col("owner_id").alias("__owner"), F.lit(True).alias("__there"))
    rows = pages.join(outbox.select(*key), key, "left_anti").join(owners, "frontier_id", "left")
    lost = F.col("__there").isNull() | ~F.coalesce(F.col("owner").isNull() | (F.col("owner") == F.col("__owner")), F.lit(False))
    rows = rows.withColumn("__refused", F.col("frontier_id").isNotNull() & F.col("next_cursor").isNotNull() & lost)
    rest = [c for c in pages.columns if c not in key]
    first = F.min_by(F.struct(*rest, "__refused"), F.struct("__refused", "received_at", F.xxhash64(*rest))).alias("__page")
    news = cut(rows.groupBy(*key).agg(first).select(*key, "__page.*"))
    kept = news.filter(~F.col("__refused"))
    produced = kept.groupBy("task_id").agg(F.count(F.lit(1)).alias("__n"))
    last = F.max_by("next_cursor", F.struct("received_at", "event_id")).alias("__cursor")
    cursors = kept.filter("frontier_id IS NOT NULL AND next_cursor IS NOT NULL").groupBy("frontier_id").agg(last)
    done = kept.filter("attempt_id IS NOT NULL").groupBy("attempt_id").agg(F.max("status_code").alias("__status"), F.max("received_at").alias("__at"))
    ended = (F.col("outcome") == "started") & F.col("__at").isNotNull()
    old = lambda name: F.col(name) if name in attempts.columns else F.lit(None)
    new = {"status_code": F.when(ended, F.col("__status")).otherwise(old("status_code")), "finished_at": F.when(ended, F.col("__at")).otherwise(old("finished_at"))}
    new["outcome"] = F.when(ended, "succeeded").otherwise(F.col("outcome"))
    return {
        "raw_page_outbox": outbox.unionByName(kept.select(*[c for c in outbox.columns if c in kept.columns]), allowMissingColumns=True),
        "crawl_tasks": frames["crawl_tasks"].join(produced, "task_id", "left").withColumn("pages_produced", F.col("pages_produced") + F.coalesce("__n", F.lit(0))).drop("__n"),
        "crawl_frontier": frontier.join(cursors, "frontier_id", "left").withColumn("cursor_in", F.coalesce("__cursor", "cursor_in")).select(*frontier.columns),
        "request_attempts": attempts.join(done, "attempt_id", "left").withColumns(new).drop("__status", "__at"),
        "refused": news.filter("__refused").select(*pages.columns),
    }


@dataclass(frozen=True)
class TaskSpec:
    """A new task: its seeds (tree -> account), limits, and requests that each operation may make."""

    task_id: str
    seeds: dict[str, str]
    max_depth: int = 5
    max_nodes: int = 100_000
    max_edges: int = 1_000_000
    max_requests: int = 10_000
    budgets: dict[str, int] = field(default_factory=lambda: {"Following": 8_000, "UserTweets": 2_000})

    def __post_init__(self) -> None:
        if not self.task_id or not self.seeds:
            raise ValueError("a task needs an id and seeds")
        if not all(self.seeds) or not all(self.seeds.values()):
            raise ValueError("trees and seeds need ids")
        if len(set(self.seeds.values())) < len(self.seeds):
            raise ValueError("a seed may start one tree only")
        if not 0 <= self.max_depth <= 5:
            raise ValueError("max_depth must be 0 to 5")
        limits = (self.max_nodes, self.max_edges, self.max_requests, *self.budgets.values())
        if not self.budgets or min(limits) <= 0:
            raise ValueError("limits and budgets must be positive")
        if len(self.seeds) > self.max_nodes:
            raise ValueError("there are more seeds than max_nodes")


def created(spark: SparkSession, spec: TaskSpec) -> dict[str, DataFrame]:
    """The rows that a new task begins with: the task, its budgets, trees, seed nodes and their work. Seeds aren't observed."""
    rows = {
        "crawl_tasks": ([(spec.task_id, "queued", 0, spec.max_depth, spec.max_requests, spec.max_nodes, spec.max_edges, len(spec.seeds))], "task_id string, status string, current_depth int, max_depth int, max_requests bigint, max_nodes bigint, max_edges bigint, nodes_created bigint"),
        "task_operation_budgets": ([(spec.task_id, name, n, 0) for name, n in spec.budgets.items()], "task_id string, operation string, max_requests bigint, requests_attempted bigint"),
        "root_trees": ([(spec.task_id, *seed) for seed in spec.seeds.items()], "task_id string, tree_id string, seed_account_id string"),
        "account_nodes": ([(spec.task_id, seed, 0, "queued") for seed in spec.seeds.values()], "task_id string, account_id string, first_depth int, expansion_status string"),
        "crawl_frontier": ([(spec.task_id, tree, seed, "Following", 0, "pending") for tree, seed in spec.seeds.items()], "task_id string, tree_id string, account_id string, operation string, depth int, status string"),
    }
    return {name: spark.createDataFrame(*told) for name, told in rows.items()}


def added(table: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows of more whose keys it doesn't have: what is added twice is there once."""
    fresh = more.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return table.unionByName(fresh, allowMissingColumns=True)


def progress(frames: dict[str, DataFrame], task_id: str, as_of: str) -> DataFrame:
    """How a task stands, as (part, name, n): work by operation and state, errors, what waits, nodes by state, and layers."""
    of = lambda df: df.filter(F.col("task_id") == task_id)
    frontier = of(frames["crawl_frontier"])
    work = frontier_counts(frontier).select(F.lit("work").alias("part"), F.concat_ws("/", "operation", "status").alias("name"), "n")
    errors = top_errors(frontier, task_id).select(F.lit("error").alias("part"), F.col("error_class").alias("name"), "n")
    waits = rate_limit_wait(frontier, as_of).select(F.lit("waiting").alias("part"), F.lit("rate_limit").alias("name"), "n")
    states = of(frames["account_nodes"]).groupBy(F.col("expansion_status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("part"), "name", "n")
    layers = of(frames["account_nodes"]).groupBy(F.col("first_depth").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("layer").alias("part"), "name", "n")
    return work.unionByName(errors).unionByName(waits).unionByName(states).unionByName(layers)
