"""Connected components of a graph of links by repeated contraction, as DataFrame joins.

In each round every node points to that node of its closed neighbourhood which has the least hash, links are redrawn
between the nodes pointed to, and loops and repeated links vanish. A share of the nodes goes in each round, so rounds
grow with the logarithm of the number of nodes, on long paths too. Each round is written to the shared checkpoint
folder, which ends its lineage. Where a node ends up is composed from the rounds' pointers.

The joins are sort-merge joins by hint: what is small is made so by contraction, not by a bound that could be checked
beforehand, and the driver builds no broadcast tables round after round.

Defined cases: links with a null end are left out; loops and repeated links change nothing; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import cut

#: Rounds after which the pointers so far are composed and written.
COMPOSED = 6


def _redrawn(edges: DataFrame) -> DataFrame:
    return cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v): two nodes have the same root if a path of links joins them."""
    edges = _redrawn(links)
    rank: Column = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("to"))
    own: Column = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("to"))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank).alias("r")).select(F.col("u").alias("at"), F.least("r", own)["to"].alias("to"))
        points = cut(least)
        rounds.append(points)
        if len(rounds) == COMPOSED:
            rounds = [cut(_composed(rounds))]
        moved = edges.join(points.hint("merge"), F.col("u") == F.col("at")).select(F.col("to").alias("u"), "v")
        edges = _redrawn(moved.join(points.hint("merge"), F.col("v") == F.col("at")).select("u", F.col("to").alias("v")))
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut(_composed(rounds)).select(F.col("at").alias("node"), F.col("to").alias("root"))


def _composed(rounds: list[DataFrame]) -> DataFrame:
    """Where each node of the first round is after the last one."""
    out = rounds[0]
    for points in rounds[1:]:
        later = points.select(F.col("at").alias("__at"), F.col("to").alias("__to"))
        out = out.join(later.hint("merge"), F.col("to") == F.col("__at"), "left").select("at", F.coalesce("__to", "to").alias("to"))
    return out
