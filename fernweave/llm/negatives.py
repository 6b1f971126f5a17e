"""Hard negatives: for an anchor and each of its positives, the rows of other labels that score highest within a window of
the positive's score. Both are exact top-k searches by inner product over an index of one-dimensional distance keys.

The index. One coordinate is added to each vector, so that all are equally long (M); then the squared distance of row x to
a query q is M^2 + |q|^2 - 2 q.x, and the highest scores are the least distances. Each row has a key (pivot, distance):
its nearest one of PIVOTS reference rows and the distance to it. Rows are stored sorted by key, in blocks that span an
interval of one pivot's keys.

A search. By the triangle inequality a block of pivot p with keys lo to hi holds no row nearer to q than
max(d(q, p) - hi, lo - d(q, p)) nor farther than d(q, p) + hi. An anchor's blocks are taken in the order of that lower
bound: intervals of keys that grow around d(q, p), for each pivot, ever wider annuli around q. After a round the k-th
best row so far bounds what is still to be looked for; blocks beyond that bound, or on the near side of a window's inner
bound, are never read for the anchor. The last round takes all blocks that the bound leaves, which certifies the top k.

At scale. A directory of blocks (at most MOST_BLOCKS and two for each partition and pivot; blocks grow instead) is what
all tasks get. Anchors ask for blocks; a block meets at most some ANCHORS_A_TASK of the anchors that ask for it in one
task, in one product of matrices; what leaves a task is k rows for each anchor and window, never a pair for each row. With
components in 64 dimensions as good as independent the bounds prune little, and the work nears that of anchors times rows, in
blocks. Distances decide only which blocks are read, with room for rounding; scores are integers and exact.

Defined cases: rows with a null id or label, a null or empty vector, a null or non-finite component, or a vector not as
long as that of the row with the least id take no part; integers beyond +-2^27 count as that; of rows with one id the one
with the least label, as text, and then vector takes part; a positive of a negative score has no negatives (its window is
empty), one of score 0 those of score 0; ties by the smaller id; an anchor without positives or negatives has no rows; an
empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import cut, matching, rewritten
from fernweave.llm.vectors import matrix, of_one_length, packed, stored

#: Reference rows, and the rows of the sample (those with the least hashes of their ids) from which they are chosen.
PIVOTS, PIVOT_SAMPLE = 16, 1024
#: Rows of a block, unless there would be over MOST_BLOCKS blocks.
BLOCK_ROWS, MOST_BLOCKS = 2048, 100_000
#: Blocks that an anchor takes in the rounds before the last one.
STEPS = (8, 64)
#: Anchors in the mean that meet a block in one task.
ANCHORS_A_TASK = 4096
#: Room for rounding in distances, as a share of M + |q|.
ROOM = 1e-6
_SLOTS = "array<struct<slot:long,top:long,low:long>>"


def usable(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, ints), each id once, and the length of the vectors."""
    kept = rows.filter(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    ints = stored(packed(kept, F.col(f"`{vector}`"), scale, id=F.col(f"`{vec_id}`").cast("long"), label=F.col(f"`{label}`").cast("string")), "negatives")
    ints, length = of_one_length(ints, [F.col("id"), F.col("ints")])
    twice = cut(ints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__of")))
    if twice.isEmpty():
        return ints, length
    one = matching(ints, twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "ints")).alias("r")).select("id", "r.label", "r.ints")
    return stored(matching(ints, twice, "id", "left_anti").unionByName(one), "negatives"), length


class Pivots:
    """Reference rows among vectors that one more coordinate makes equally long."""

    def __init__(self, sample: np.ndarray, longest: int, count: int) -> None:
        self.squared = float(longest)  # M^2
        chosen = sample[:1].astype(np.float64)
        while len(chosen) < min(count, len(sample)):  # the one farthest from those chosen
            chosen = np.concatenate([chosen, sample[[int(self._to(sample, chosen).min(axis=1).argmax())]]])
        self.rows = chosen

    def _to(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        extra = [np.sqrt(np.maximum(self.squared - (x.astype(np.float64) ** 2).sum(axis=1), 0)) for x in (rows, others)]
        return 2 * self.squared - 2 * (rows @ others.T + np.outer(*extra))

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows of the table, rows x pivots."""
        return np.sqrt(np.maximum(self._to(rows, self.rows), 0))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        """Distances of queries, whose further coordinate is 0."""
        return np.sqrt(np.maximum(self.squared + (queries.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * (queries @ self.rows.T), 0))


def indexed(ints: DataFrame, length: int, pivots: Pivots, rows: int) -> DataFrame:
    """(block, pivot, lo, hi, n, ids, labels, ints): the rows sorted by (pivot, distance, id), in blocks."""
    most = max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = pivots.of_rows(matrix(batch.column("ints"), length))
            nearest = distance.argmin(axis=1) if len(distance) else np.empty(0, dtype=np.int64)
            key = distance[np.arange(len(nearest)), nearest]
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), pa.array(key, pa.float64()), *batch.columns], ["pivot", "key", *batch.schema.names])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block(part: pa.Table) -> pa.RecordBatch:
            keys = part.column("key").to_numpy()
            ids = part.column("id").to_numpy().astype("<i8").tobytes()
            values = [[int(part.column("pivot")[0].as_py())], [float(keys[0])], [float(keys[-1])], [len(keys)], [ids], [part.column("label").to_pylist()], [b"".join(part.column("ints").to_pylist())]]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["pivot", "lo", "hi", "n", "ids", "labels", "ints"])

        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            for start, end in zip(*(lambda at: (at, [*at[1:], len(pivot)]))([0, *(np.flatnonzero(np.diff(pivot)) + 1)]), strict=True):
                if held and held[0].column("pivot")[0].as_py() != pivot[start : start + 1].tolist()[0]:
                    yield block(pa.Table.from_batches(held))
                    held, count = [], 0
                while start < end:
                    take = min(end - start, most - count)
                    held.append(batch.slice(start, take))
                    count, start = count + take, start + take
                    if count == most:
                        yield block(pa.Table.from_batches(held))
                        held, count = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    keys = ints.mapInArrow(keyed, "pivot int, key double, id long, label string, ints binary")
    spread = int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(max(1, min(spread, -(-rows // most))), "pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    made = ordered.mapInArrow(blocks, "pivot int, lo double, hi double, n long, ids binary, labels array<string>, ints binary")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), "negatives-index")


class Directory:
    """Which blocks a query's search takes, nearest first."""

    def __init__(self, rows: list, pivots: Pivots) -> None:
        self.block, self.pivot, self.lo, self.hi = (np.array([r[k] for r in rows]) for k in ("block", "pivot", "lo", "hi"))
        self.pivots = pivots

    def asked(self, query: np.ndarray, to_pivots: np.ndarray, slots: list[dict], start: int, step: int | None) -> np.ndarray:
        """Blocks from place `start` in the order of their lower bounds, `step` at most, that may hold what a slot looks for.

        A slot looks for scores from low (null: any) to top (null: any).
        """
        length = self.pivots.squared + float((query.astype(np.float64) ** 2).sum())
        room = ROOM * np.sqrt(length) + 1e-3
        away = to_pivots[self.pivot]
        nearest, farthest = np.maximum(np.maximum(away - self.hi, self.lo - away), 0), away + self.hi
        order = np.lexsort((self.block, nearest))[start : None if step is None else start + step]
        wanted = np.zeros(len(order), dtype=bool)
        for slot in slots:
            outer = np.inf if slot["low"] is None else np.sqrt(max(length - 2 * slot["low"], 0)) + room
            inner = 0 if slot["top"] is None else np.sqrt(max(length - 2 * slot["top"], 0)) - room
            wanted |= (nearest[order] <= outer) & (farthest[order] >= inner)
        return self.block[order[wanted]]


def best(table: pa.Table, asks: pa.Table, length: int, k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, slot, row, score): for each slot the k best rows of a block, of the anchor's label or of other ones."""
    ids = np.frombuffer(table.column("ids")[0].as_py(), dtype="<i8")
    x = np.frombuffer(table.column("ints")[0].as_py(), dtype="<i4").astype(np.int64).reshape(len(ids), length)
    names, labels = np.unique(np.array(table.column("labels")[0].as_py(), dtype=object), return_inverse=True)
    of = {name: i for i, name in enumerate(names.tolist())}
    queries = matrix(asks.column("ints"), length)
    small = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * length < 2**53
    # products of doubles are exact below 2^53; else of integers
    scores = (x.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64) if small else x @ queries.T
    for j, (anchor, label, slots) in enumerate(zip(*(asks.column(c).to_pylist() for c in ("anchor_id", "label", "slots")), strict=True)):
        own = labels == of.get(label, -1)
        allowed = (own & (ids != anchor)) if same else ~own
        for slot in slots:
            fits = allowed.copy()
            if slot["top"] is not None:
                fits &= scores[:, j] <= slot["top"]
            if slot["low"] is not None:
                fits &= scores[:, j] >= slot["low"]
            at = np.flatnonzero(fits)
            if len(at) > k:
                found = scores[at, j]
                at = at[found >= np.partition(found, len(at) - k)[len(at) - k]]
            for i in at[np.lexsort((ids[at], -scores[at, j]))[:k]].tolist():
                yield anchor, slot["slot"], int(ids[i]), int(scores[i, j])


def searched(index: DataFrame, directory: Directory, anchors: DataFrame, count: int, length: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, id, score, place): for each slot of the anchors (anchor_id, label, ints, slots) its k best rows.

    count: number of anchors. same: whether rows have the anchor's label (and are not the anchor) or other labels.
    """
    parts, found, state, start = -(-max(count, 1) // ANCHORS_A_TASK), None, anchors, 0
    sent = index.sparkSession.sparkContext.broadcast(directory)
    steps = [*STEPS, None]
    steps = steps[: next(i for i, s in enumerate(steps) if s is None or sum(steps[: i + 1]) >= len(directory.block)) + 1]
    for step in steps:

        def ask(batches: Iterator[pa.RecordBatch], start: int = start, step: int | None = step) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                queries = matrix(batch.column("ints"), length)
                away = own.pivots.of_queries(queries)
                blocks = [own.asked(q, d, s, start, step) for q, d, s in zip(queries, away, batch.column("slots").to_pylist(), strict=True)]
                rows = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
                taken = pa.array(np.concatenate(blocks) if len(rows) else [], pa.int64())
                yield pa.RecordBatch.from_arrays([taken, *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], ["block", *batch.schema.names])

        def scan(blocks: pa.Table, asks: pa.Table) -> pa.Table:
            rows = list(best(blocks, asks, length, k, same)) if len(blocks) and len(asks) else []
            return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["anchor_id", "slot", "id", "score"])

        asks = state.mapInArrow(ask, f"block long, anchor_id long, label string, ints binary, slots {_SLOTS}").withColumn("part", F.pmod(F.hash("anchor_id"), F.lit(parts)))
        dealt = index.select("block", "ids", "labels", "ints", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        new = dealt.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(scan, "anchor_id long, slot long, id long, score long")
        every = new if found is None else found.drop("place").unionByName(new)
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
        found = rewritten(every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k), "negatives-found")
        start += step or 0
        if step != steps[-1]:
            # from here on a slot that is full looks for nothing below its k-th best score
            full = found.filter(F.col("place") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))
            slot = lambda s: F.struct(s["slot"].alias("slot"), s["top"].alias("top"), F.coalesce(F.element_at("full", s["slot"]), s["low"]).alias("low"))
            held = anchors.join(full, "anchor_id", "left").withColumn("full", F.coalesce("full", F.expr("map_from_arrays(array(), array())").cast("map<bigint,bigint>")))
            state = held.withColumn("slots", F.transform("slots", slot)).drop("full")
    return found


def hard_negatives(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the ids divisible by `every`.

    A negative fits a positive if its score is from `least` to `most` hundredths of the positive's.
    """
    spark = rows.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ints, length = usable(rows, vec_id, vector, label, scale)
    total = ints.count()
    if not total:
        return spark.createDataFrame([], names)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (matrix(batch.column(0), length) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.max(initial=0))], pa.int64())], ["n"])

    longest = ints.select("ints").mapInArrow(norms, "n long").agg(F.max("n")).first()[0]
    sample = ints.orderBy(F.xxhash64("id"), "id").select("ints").limit(PIVOT_SAMPLE).collect()
    pivots = Pivots(matrix(pa.array([bytes(r["ints"]) for r in sample], pa.binary()), length), longest, PIVOTS)
    index = indexed(ints, length, pivots, total)
    directory = Directory(index.select("block", "pivot", "lo", "hi").collect(), pivots)
    none = F.lit(None).cast("long")
    chosen = ints.filter(F.col("id") % every == 0)
    anchors = rewritten(chosen.select(F.col("id").alias("anchor_id"), "label", "ints", F.array(F.struct(F.lit(0).cast("long").alias("slot"), none.alias("top"), none.alias("low"))).alias("slots")), "negatives-anchors")
    count = anchors.count()
    near = searched(index, directory, anchors, count, length, positives, same=True)
    pairs = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # quotients of integers, exact: the least score from `least` hundredths up, the greatest up to `most` hundredths
    score = F.col("positive_score")
    low, top = -F.expr(f"(-positive_score * {least} - pmod(-positive_score * {least}, 100)) div 100"), F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    windows = pairs.withColumns({"low": low, "top": top}).filter((score >= 0) & (F.col("low") <= F.col("top")))
    slots = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("slot"), "top", "low"))).alias("slots"))
    far = searched(index, directory, rewritten(anchors.drop("slots").join(slots, "anchor_id").select("anchor_id", "label", "ints", "slots"), "negatives-anchors"), count, length, negatives, same=False)
    found = far.select("anchor_id", F.col("slot").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
