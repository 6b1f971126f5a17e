"""The graph as a stream of pages leaves it, kept by key: what a batch changes is what follows from its pages.

Each account of a task has a state of its own: its first discovery, the accounts on whose lists it is and where, which
accounts its own list has, what it says it follows, and its number of followers. Rows come to an account in three roles: it
was found on a list, its list names an account, its list was asked for. What a state emits are changes: its node whenever
that is another than before, and each edge that is new or was found at an earlier place. They are upserted into tables by key.

Order. A discovery's place is (depth of the list's owner, tree, owner, time and id of the page, place on the page). An
account belongs to its least discovery; the least one of an owner is the edge's. Least values don't depend on the order in
which pages come, so any order of delivery, repeats included, ends in the same tables, and in those that the layered build
makes of the same pages. Whether an edge is a collision, and how deep its target is, follow from the target's node and are
joined when edges are read: a late page that moves an account nearer rewrites one node and none of its edges.

At scale. State is kept by (task, account) in RocksDB on the executors' disks, followers of an account as entries of a map
that are looked up one by one: a batch touches the entries of its own rows, however many followers there are. An account
that many lists name has as many rows in a batch as the batch has lists, in one task; files for each batch bound that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fernweave.common import with_groups
from fernweave.functions.payload import user_profile, walked
from fernweave.operators.graph import MAX_DEPTH, Graph
from fernweave.sources import events
from fernweave.streaming.ingest import Store, delivered_once, stateful, task_ids
from fernweave.streaming.keyed import KeyedTable

#: Roles of rows: found on a list, names an account on its own list, its list was asked for.
FOUND, NAMES, ASKED = "found", "names", "asked"
PLACE = "depth int, tree string, owner string, at string, event string, ord long"
NODE = "task_id string, account_id string, tree_id string, first_depth int, owner string, followers bigint, network_indegree bigint, collected_following bigint, declared_following int"
EDGE = "task_id string, source string, target string, tree_id string, source_depth int, at string, event string, ord long"
CHANGES = f"kind string, {NODE}, source string, target string, source_depth int, at string, event string, ord long"
_COLUMNS = [part.split(" ")[0] for part in CHANGES.split(", ")]


def discoveries(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, account_id, role, other, followers, following, and the columns of a place) of the Following pages among messages (value)."""
    pages = events.decoded(delivered_once(messages)).filter(F.col("problem").isNull() & (F.col("operation") == "Following") & F.col("depth").isNotNull())
    pages = pages.join(task_ids(tasks), "task_id", "left_semi")
    place = F.struct("depth", F.coalesce("tree_id", F.lit("")).alias("tree"), F.col("source").alias("owner"), F.coalesce(F.col("requested_at").cast("string"), F.lit("")).alias("at"), F.col("event_id").alias("event"))
    pages = pages.select("task_id", F.col("account_id").alias("source"), "depth", "tree_id", "requested_at", "event_id", "payload").withColumn("place", place)
    none = F.lit(None)
    asked = pages.select("task_id", F.col("source").alias("account_id"), F.lit(ASKED).alias("role"), none.cast("string").alias("other"), F.struct("place.*", F.lit(-1).cast("long").alias("ord")).alias("place"), none.cast("bigint").alias("followers"), none.cast("int").alias("following"))
    users = walked(pages.select("task_id", "source", "place", "payload"), ["User"]).withColumn("u", user_profile(F.col("obj"))).filter(F.col("u").isNotNull())
    users = users.select("task_id", "source", F.struct("place.*", "ord").alias("place"), F.col("u.account_id").alias("target"), F.col("u.followers_count").cast("bigint").alias("followers"), F.col("u.following_count").alias("following"))
    row = lambda account, role, other: F.struct(F.col(account).alias("account_id"), F.lit(role).alias("role"), F.col(other).alias("other"))
    own = F.col("source") == F.col("target")  # a page may hold its owner's profile, which tells how many it follows
    both = users.withColumn("r", F.explode(F.when(own, F.array(row("target", ASKED, "source"))).otherwise(F.array(row("target", FOUND, "source"), row("source", NAMES, "target")))))
    found = both.select("task_id", "r.account_id", "r.role", "r.other", "place", "followers", "following")
    return asked.unionByName(found).select("*", "place.*").drop("place")


class Accounts(StatefulProcessor):
    """The state of (task, account); its parts are described above."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        first = "depth int, tree string, owner string, at string, event string, ord long, followers bigint"
        self.first = handle.getValueState("first", first)
        self.counts = handle.getValueState("counts", "followed bigint, collected bigint, seed string, asked boolean")
        self.told = handle.getValueState("told", "own_at string, own_event string, own int, by_at string, by_event string, by int")
        self.by = handle.getMapState("by", "owner string", PLACE)
        self.names = handle.getMapState("names", "target string", "n int")

    def handleInitialState(self, key: tuple, initial: Row, timers: object) -> None:  # noqa: N802 - the operator's interface
        """A seed of a task, by the first of its trees."""
        self.counts.update((0, 0, initial.tree_id, False))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:  # noqa: N802
        found: dict[str, tuple] = {}
        named: set[str] = set()
        first = tuple(self.first.get()) if self.first.exists() else None
        followed, collected, seed, asked = self.counts.get() if self.counts.exists() else (0, 0, None, False)
        told = tuple(self.told.get()) if self.told.exists() else (None,) * 6
        before = (first, followed, collected, seed, asked, told)
        for row in rows:
            place = (row.depth, row.tree, row.owner, row.at, row.event, row.ord)
            if row.role == FOUND:
                if row.other not in found or place < found[row.other]:
                    found[row.other] = place
                if first is None or place < first[:6]:
                    first = (*place, row.followers)
                if row.following is not None and (told[3] is None or place[3:5] >= told[3:5]):
                    told = (*told[:3], place[3], place[4], row.following)
            elif row.role == NAMES:
                named.add(row.other)
            else:
                asked = True
                if place[0] == 0 and (seed is None or place[1] < seed):
                    seed = place[1]
                if row.following is not None and (told[0] is None or place[3:5] >= told[:2]):
                    told = (place[3], place[4], row.following, *told[3:])
        changed = []
        for owner, place in found.items():
            known = tuple(self.by.getValue((owner,))) if self.by.containsKey((owner,)) else None
            if known is None or place < known:
                self.by.updateValue((owner,), place)
                followed += known is None
                changed.append(place)
        for target in named:
            if not self.names.containsKey((target,)):
                self.names.updateValue((target,), (1,))
                collected += 1
        if (first, followed, collected, seed, asked, told) == before:
            return
        if first != before[0]:
            self.first.update(first)
        self.counts.update((followed, collected, seed, asked))
        if told != before[5]:
            self.told.update(told)
        declared = (told[2] if told[2] is not None else told[5]) if asked else None
        task, account = key
        empty = dict.fromkeys(_COLUMNS)
        root = {"tree_id": seed, "first_depth": 0, "owner": None, "followers": None}
        # a list that was asked for before any page named its owner: its node comes with that page
        if seed is not None or first is not None:
            by = root if seed is not None else {"tree_id": first[1], "first_depth": first[0] + 1, "owner": first[2], "followers": first[6]}
            yield Row(**(empty | {"kind": "node", "task_id": task, "account_id": account, "network_indegree": followed, "collected_following": collected, "declared_following": declared} | by))
        for depth, tree, owner, at, event, ord_ in changed:
            yield Row(**(empty | {"kind": "edge", "task_id": task, "tree_id": tree, "source": owner, "target": account, "source_depth": depth, "at": at, "event": event, "ord": ord_}))

    def close(self) -> None:
        pass


class GraphTables:
    """The stored nodes and edges of a stream, and the model's tables as they follow from them."""

    def __init__(self, store: Store) -> None:
        self.nodes = KeyedTable(store.spark, f"{store.path}/graph/nodes", NODE, ["task_id", "account_id"])
        self.edges = KeyedTable(store.spark, f"{store.path}/graph/edges", EDGE, ["task_id", "source", "target"])

    def apply(self) -> Callable[[DataFrame, int], None]:
        def run(changes: DataFrame, batch: int) -> None:
            changes = changes.persist()
            try:
                self.edges.upsert(changes.filter("kind = 'edge'"), batch)
                self.nodes.upsert(changes.filter("kind = 'node'"), batch)
            finally:
                changes.unpersist()

        return run

    def graph(self, task_id: str, seeds: DataFrame, max_depth: int = MAX_DEPTH, min_followers: int = 0) -> Graph:
        """The task's graph as the layered build gives it. seeds (tree_id, account_id): those that no page has named are nodes too."""
        nodes = self.nodes.read().filter(F.col("task_id") == task_id).drop("task_id")
        rest = seeds.groupBy("account_id").agg(F.min("tree_id").alias("tree_id")).join(nodes, "account_id", "left_anti")
        zero = {c: F.lit(0).cast("bigint") for c in ("network_indegree", "collected_following")} | {"first_depth": F.lit(0)}
        nodes = nodes.unionByName(rest.withColumns(zero), allowMissingColumns=True)
        few = F.coalesce(F.col("followers") < min_followers, F.lit(False)) & F.col("first_depth").between(1, max_depth)
        status = F.when(F.col("first_depth") > max_depth, "boundary").when(few, "filtered").otherwise("pending")
        full = nodes.select("account_id", "tree_id", "first_depth", (F.col("first_depth") > max_depth).alias("is_l6_boundary"), status.alias("expansion_status"), F.when(few, "below_follower_threshold").alias("filter_reason"), "network_indegree", "collected_following", "declared_following")
        edges = self.edges.read().filter(F.col("task_id") == task_id)
        of = nodes.select(F.col("account_id").alias("target"), F.col("first_depth").alias("target_depth"), F.col("owner").alias("first_owner"), "network_indegree")
        edges = with_groups(edges, of, "target", "network_indegree", edges.count())
        edges = edges.withColumn("is_collision", ~F.coalesce(F.col("first_owner") == F.col("source"), F.lit(False)))
        ends = [F.col("source").alias("source_account_id"), F.col("target").alias("target_account_id")]
        on_edges = edges.select(*ends, "source_depth", "target_depth", (F.col("target_depth") > max_depth).alias("is_l6_boundary"))
        told = edges.filter("tree_id <> ''")  # a page without a tree makes edges and no observations
        observed = told.select("tree_id", F.col("target").alias("account_id"), F.col("source").alias("parent_account_id"), (F.col("source_depth") + 1).alias("depth"), "is_collision")
        return Graph(full, on_edges, observed, told.select("tree_id", *ends, "source_depth", "target_depth", "is_collision"))


def start(messages: DataFrame, store: Store, tasks: DataFrame, seeds: DataFrame, once: bool = True) -> StreamingQuery:
    """The stream of messages (value) into the store's graph. seeds: task_id, account_id, tree_id; they are read when the stream starts first."""
    first = seeds.groupBy("task_id", "account_id").agg(F.min("tree_id").alias("tree_id"))
    rows = discoveries(messages, tasks).groupBy("task_id", "account_id")
    changes = rows.transformWithState(Accounts(), CHANGES, "Append", "None", first.groupBy("task_id", "account_id"))
    writer = changes.writeStream.foreachBatch(GraphTables(store).apply()).outputMode("append").option("checkpointLocation", f"{store.path}/graph/checkpoint")
    with stateful(store.spark):
        return (writer.trigger(availableNow=True) if once else writer).start()
