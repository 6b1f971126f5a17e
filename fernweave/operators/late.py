"""The layered graph with pages that come late: what they change is worked out from them, not from all pages.

An account's label is its least discovery: (depth, tree, owner, page, position), seeds before all others. Labels are the
least fixed point of the lists: a row on the list of an account that is expanded offers its target the label that follows
from the owner's. New rows make offers; targets whose labels get less make new offers by their own lists, and so on until
none does (semi-naive evaluation: a round joins the labels that changed in the round before with the lists of just those
accounts). Labels only ever get less, and a late page of a closed layer that brings an account nearer, or to another
discoverer, moves what hangs on it: nodes, and by them edges, observations and trees.

One change isn't a lesser label: an account that was expanded and, by its new first discovery, has too few followers. What
its list offered must be withdrawn then, and the labels are worked out anew from all lists.

Lists and labels are tables by key, lists in buckets by owner, labels by account, so a round reads the buckets of the accounts that
changed. A batch of pages is applied once; one that failed half-way is given again and ends in the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import cut, with_groups
from fernweave.operators.graph import MAX_DEPTH, Graph, indegree
from fernweave.streaming.keyed import BUCKETS, KeyedTable

LIST = "source string, page_no int, position bigint, target string, followers int"
LABEL = "account_id string, first_depth int, tree_id string, source string, page_no int, position bigint, followers int"
_ORDER = ["first_depth", "tree_id", "source", "page_no", "position", "followers"]


def _label(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in _ORDER])


class LateGraph:
    """A layered graph under a path. seeds: tree_id, account_id; as in graph.build, which it equals after any batches of pages."""

    def __init__(self, spark: SparkSession, path: str, seeds: DataFrame, max_depth: int = MAX_DEPTH, min_followers: int = 0, buckets: int = BUCKETS) -> None:
        self.spark, self.seeds, self.max_depth, self.min_followers = spark, seeds, max_depth, min_followers
        self.lists = KeyedTable(spark, f"{path}/lists", LIST, ["source", "page_no", "position", "target"], buckets=buckets, bucket_by=["source"])
        self.labels = KeyedTable(spark, f"{path}/labels", LABEL, ["account_id"], buckets=buckets)
        #: Rows of lists that the rounds of the last batch were offered by.
        self.offered: list[int] = []

    def _expands(self, depth: Column, followers: Column) -> Column:
        few = F.coalesce(followers < self.min_followers, F.lit(False)) & (depth > 0)
        return (depth <= self.max_depth) & ~few

    def _offers(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """The least label that the rows offer each target, from the labels (account_id, ...) of their owners."""
        by = labels.filter(self._expands(F.col("first_depth"), F.col("followers"))).select(F.col("account_id").alias("source"), (F.col("first_depth") + 1).alias("first_depth"), "tree_id")
        offered = cut(rows.join(by, "source"))
        self.offered.append(offered.count())
        return offered.groupBy(F.col("target").alias("account_id")).agg(F.min(_label()).alias("new"))

    def _settled(self, changed: DataFrame, offers: DataFrame, known: bool) -> tuple[DataFrame, bool]:
        """All labels that change, from those that did and what was offered; whether an offer must be withdrawn."""
        withdrawn = False
        while True:
            stored = self.labels.lookup(offers.select("account_id")) if known else self.spark.createDataFrame([], LABEL)
            before = stored.join(changed, "account_id", "left_anti").unionByName(changed).select("account_id", _label().alias("old"))
            less = offers.join(before, "account_id", "left").filter(F.col("old").isNull() | (F.col("new") < F.col("old")))
            less = cut(less)
            if less.isEmpty():
                return changed, withdrawn
            lost = self._expands(F.col("old.first_depth"), F.col("old.followers")) & ~self._expands(F.col("new.first_depth"), F.col("new.followers"))
            withdrawn = withdrawn or not less.filter(lost).isEmpty()
            new = less.select("account_id", "new.*")
            changed = cut(changed.join(new, "account_id", "left_anti").unionByName(new))
            if withdrawn:
                return changed, True
            expanded = new.filter(self._expands(F.col("first_depth"), F.col("followers")))
            offers = self._offers(self.lists.lookup(expanded.select(F.col("account_id").alias("source"))), expanded)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Apply pages (source, page_no, position, target, followers); the labels that changed."""
        self.offered = []
        rows = cut(rows.filter(F.col("target") != F.col("source")).select(*self.lists.columns))
        self.lists.upsert(rows, batch)
        roots = self.seeds.groupBy("account_id").agg(F.min("tree_id").alias("tree_id"))
        nothing = {"source": F.lit(""), "page_no": F.lit(0), "position": F.lit(0).cast("long"), "followers": F.lit(None).cast("int"), "first_depth": F.lit(0)}
        roots = cut(roots.withColumns(nothing).select(*self.labels.columns))
        fresh = cut(roots.join(self.labels.lookup(roots.select("account_id")).select("account_id"), "account_id", "left_anti"))
        owners = self.labels.lookup(rows.select(F.col("source").alias("account_id"))).unionByName(fresh)
        offers = self._offers(rows, owners)
        if not fresh.isEmpty():  # the first batch, or seeds that are new
            more = self._offers(self.lists.lookup(fresh.select(F.col("account_id").alias("source"))), fresh)
            offers = offers.unionByName(more).groupBy("account_id").agg(F.min("new").alias("new"))
        changed, withdrawn = self._settled(fresh, offers, known=True)
        if withdrawn:
            changed = self._anew(roots)
        self.labels.upsert(changed, batch)
        return changed

    def _anew(self, roots: DataFrame) -> DataFrame:
        """All labels from all lists; accounts that no list reaches any more have no depth."""
        offers = self._offers(self.lists.lookup(roots.select(F.col("account_id").alias("source"))), roots)
        labels = roots
        while True:
            new = cut(offers.join(labels, "account_id", "left_anti").select("account_id", "new.*"))
            if new.isEmpty():
                break
            labels = cut(labels.unionByName(new))
            expanded = new.filter(self._expands(F.col("first_depth"), F.col("followers")))
            offers = self._offers(self.lists.lookup(expanded.select(F.col("account_id").alias("source"))), expanded)
        gone = self.labels.read().join(labels, "account_id", "left_anti").withColumn("first_depth", F.lit(None).cast("int"))
        return cut(labels.unionByName(gone))

    def graph(self) -> Graph:
        """nodes, edges, observations: as graph.build makes them of all pages so far."""
        labels = cut(self.labels.read().filter("first_depth IS NOT NULL"))
        depth = F.col("first_depth")
        by = labels.filter(self._expands(depth, F.col("followers"))).select(F.col("account_id").alias("source"), F.col("first_depth").alias("source_depth"), "tree_id")
        rows = self.lists.read().groupBy("source", "target").agg(F.lit(1).alias("one")).drop("one").join(by, "source")
        of = labels.select(F.col("account_id").alias("target"), F.col("first_depth").alias("target_depth"), F.col("source").alias("owner"))
        times = rows.groupBy("target").agg(F.count(F.lit(1)).alias("times"))
        edges = cut(with_groups(rows, of.join(times, "target"), "target", "times", rows.count()))
        edges = edges.withColumn("is_collision", F.col("owner") != F.col("source"))
        ends = [F.col("source").alias("source_account_id"), F.col("target").alias("target_account_id")]
        on_edges = edges.select(*ends, "source_depth", "target_depth", (F.col("target_depth") > self.max_depth).alias("is_l6_boundary"))
        out = edges.groupBy(F.col("source").alias("account_id")).agg(F.count(F.lit(1)).alias("collected"))
        full = labels.join(indegree(on_edges), "account_id", "left").join(out, "account_id", "left")
        boundary = depth > self.max_depth
        filtered = ~boundary & ~self._expands(depth, F.col("followers"))
        status = F.when(boundary, "boundary").when(filtered, "filtered").otherwise("pending")
        full = full.select("account_id", "tree_id", "first_depth", boundary.alias("is_l6_boundary"), status.alias("expansion_status"), F.when(filtered, "below_follower_threshold").alias("filter_reason"), F.coalesce("n", F.lit(0)).alias("network_indegree"), F.coalesce("collected", F.lit(0)).alias("collected_following"))
        observed = edges.select("tree_id", F.col("target").alias("account_id"), F.col("source").alias("parent_account_id"), (F.col("source_depth") + 1).alias("depth"), "is_collision")
        return Graph(full, on_edges, observed, edges.select("tree_id", *ends, "source_depth", "target_depth", "is_collision"))
