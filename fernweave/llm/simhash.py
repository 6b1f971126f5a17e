"""SimHash near-dedup by the generalised pigeonhole principle.

1. Fingerprints. A text's words, A-Z lower-cased, give shingles; the XXH64 (seed 42) of each shingle, repeats included,
   votes on 64 bits, and a bit is 1 if it is set in over half of them. Further groups of 64 bits (`groups` above 1) come
   from mixing the same hashes again; they let links be checked by more bits than are searched.
2. Partitions. How often each bit and each pair of bits is set is counted over all distinct fingerprints; bits that
   vary together are put into one partition, which leaves the others more selective.
3. Thresholds. Two fingerprints that differ in at most tau bits differ in at most t_i bits in some partition i, for any
   t_i of -1 (never probed) or more that add up to tau - m + 1 over m partitions. From the counts comes, for each
   partition, the chance that two fingerprints differ in at most t bits there (a beta-binomial with the mean and the
   variance of that number, so correlated bits count); dynamic programming picks the t_i, and the number of partitions,
   of least estimated cost. This changes what the search costs, never what it finds.
4. Probe. Each distinct fingerprint is filed in partition i under its bits there with every choice of up to t_i bits
   masked out. Fingerprints filed together are compared with numpy, in runs of a sorted shuffle; what leaves a run is no
   list of pairs but one link to a root for each fingerprint that another one is near to. A run of over BLOCK
   fingerprints is dealt out as pairs of blocks, so it never meets in one task, and none of its pairs is left out.
5. Components of the links, by contraction (see components).

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle, and one of any length is read whole; a bit that is set in just half of the hashes is 0; equal
texts, repeated rows and null ids are rows of the same fingerprint; an empty table gives an empty result; further columns do not reach the output of `near_components` and pass through `near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.llm.bpe import ranges
from fernweave.llm.common import MOST_KEYS, any_columns, cut, filter_of, matching, passing, slices, with_groups
from fernweave.llm.components import components

SEED = 42
#: Fingerprints of a run that are compared in one task; longer runs are dealt out as pairs of blocks.
BLOCK = 4096
#: Rows of a run up to which it is compared together with its neighbours in the sorted order.
SHORT = 12
#: Estimated seconds to file a fingerprint once, and to compare two.
FILE_S, COMPARE_S = 3e-6, 6e-9
#: The part of all comparisons that is left where fingerprints must also be of texts of about one size.
BANDED = 0.17
#: Odd multipliers that mix a hash into further groups of 64 bits.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(words) - shingle + 1)


def votes(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as an unsigned integer."""
    if not len(hashes):
        return 0
    held = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    of_byte = np.bincount(held.ravel(), minlength=2048).reshape(8, 256)
    bits = (of_byte @ _BIT_OF_BYTE).ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def mixed(hashes: np.ndarray, group: int) -> np.ndarray:
    """The hashes themselves for group 0, else 64 further bits of each."""
    if not group:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(MIXERS[group - 1])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, groups: int = 1, sized: bool = False) -> DataFrame:
    """docs without the text, with f0, f1, ...: 64 bits each, as signed longs; and size, the number of distinct shingles."""
    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias("__text"))
    names = columns_of(groups, sized)
    schema = kept.drop("__text").schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            at = part.schema.get_field_index("__text")
            found = np.zeros((part.num_rows, len(names)), dtype=np.uint64)
            for i, value in enumerate(part.column(at)):
                hashes = shingle_hashes(value.as_py(), shingle)
                found[i] = [votes(mixed(hashes, g)) for g in range(groups)] + [len(np.unique(hashes))] * sized
            rest = [c for i, c in enumerate(part.columns) if i != at]
            columns = rest + [pa.array(found[:, k].copy().view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [c for c in part.schema.names if c != "__text"] + names)

    return kept.mapInArrow(run, schema)


def columns_of(groups: int, sized: bool) -> list[str]:
    return [f"f{g}" for g in range(groups)] + ["size"] * sized


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows of nodes, and how often bits b and c of f0 are set together (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for start in range(0, len(raw), 50_000):
                bits = np.unpackbits(raw[start : start + 50_000], axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(both.ravel(), n).astype(np.int64)])], ["sums"])

    told = nodes.select("f0").mapInArrow(run, "sums array<long>").select(F.posexplode("sums"))
    # 4,097 sums, whatever the input
    sums = {row["pos"]: row["s"] for row in told.groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    return sums.get(4096, 0), np.array([sums.get(k, 0) for k in range(4096)], dtype=float).reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` partitions of about equal size, bits that vary together in the same one."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        own = [max(left, key=lambda b: (alike[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (alike[b, own].sum(), -b)))  # noqa: B023
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def chance_within(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t = 0..most: the chance that two fingerprints differ in at most t of the bits."""
    w = len(bits)
    n11 = both[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(n11)
    n10 = p[:, None] - n11
    n01, n00 = n10.T, 1 - n11 - n10 - n10.T
    differ = 2 * (n11 * n00 + n10 * n01)  # both bits differ
    mean = float(np.trace(differ))
    variance = float(differ.sum()) - mean * mean
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((variance / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.95)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    log_beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    out, total = [], 0.0
    for t in range(most + 1):
        total += comb(w, t) * exp(log_beta(t + a, w - t + b) - log_beta(a, b)) if t <= w else 0.0
        out.append(min(total, 1.0))
    return out


def allocated(n: int, both: np.ndarray, tau: int, compare_s: float = COMPARE_S) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition: the cheapest of all allocations of tau - m + 1 over m partitions, for any m."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    n = max(n, 2)  # without rows all allocations would cost the same
    for m in range(2, min(tau + 1, 16) + 1):
        parts = grouped_bits(n, both, m)
        costs = []
        for bits in parts:
            chance = chance_within(n, both, bits, tau)
            filed = [sum(comb(len(bits), d) for d in range(t + 1)) for t in range(tau + 1)]
            costs.append([0.0] + [n * filed[t] * FILE_S + n * n / 2 * chance[t] * compare_s for t in range(tau + 1)])
        # least[s]: cost and thresholds of the partitions so far whose thresholds plus one add up to s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, chosen) in least.items():
                for t in range(-1, tau + 1):
                    key = s + t + 1
                    if key <= tau + 1 and (key not in after or cost + own[t + 1] < after[key][0]):
                        after[key] = (cost + own[t + 1], (*chosen, t))
            least = after
        cost, chosen = least[tau + 1]
        if best is None or cost < best[0]:
            best = (cost, list(zip(parts, chosen, strict=True)))
    return best[1] if best else [(list(range(64)), tau)]


def as_mask(bits: list[int] | tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def filings(partitions: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(bits that are compared, bits that are masked out and must all differ), for each way in which a row is filed."""
    out = []
    for bits, t in partitions:
        for d in range(t + 1):
            out += [(as_mask([b for b in bits if b not in gone]), as_mask(gone)) for gone in combinations(bits, d)]
    return out


@dataclass(frozen=True)
class Limits:
    """tau: bits of f0 that may differ. tau_all: bits of all groups. ratio: of the lesser to the greater size, at least.

    Rows are arrays with a column for each group, and one more for the size if there is a ratio.
    """

    tau: int
    tau_all: int | None = None
    ratio: float | None = None

    def linked(self, a: np.ndarray, b: np.ndarray, masked: np.ndarray | np.uint64) -> np.ndarray:
        """Whether rows of a and b are linked: a way's masked bits must all differ, or another way has the pair."""
        first = a[..., 0] ^ b[..., 0]
        out = (np.bitwise_count(first) <= self.tau) & ((first & masked) == masked)
        if (self.tau_all is None and self.ratio is None) or not out.any():
            return out
        at = np.nonzero(out)
        x, y = (z[at] for z in np.broadcast_arrays(a, b))
        good = np.ones(len(x), dtype=bool)
        if self.ratio is not None:
            low, high = np.minimum(x[:, -1], y[:, -1]), np.maximum(x[:, -1], y[:, -1])
            good &= low >= high * self.ratio - 1e-9
            x, y = x[:, :-1], y[:, :-1]
        if self.tau_all is not None:
            good &= np.bitwise_count(x ^ y).sum(axis=-1) <= self.tau_all
        out[at] = good
        return out

    def reach(self, sizes: np.ndarray, last: int) -> int:
        """In rows in the order of their sizes: how many of them can be linked to a row up to the place `last`."""
        return len(sizes) if self.ratio is None else int(np.searchsorted(sizes, sizes[last] / self.ratio + 1e-6, "right"))


def roots_of(prints: np.ndarray, limits: Limits, masked: int) -> np.ndarray:
    """For each row of a run the place of its component's first row; compared in stripes of a million cells at most."""
    n = len(prints)
    label = np.arange(n)
    stripe = max(1, 1_000_000 // n) if limits.ratio is None else 64
    sizes = prints[:, -1].astype(np.float64)
    for start in range(0, n, stripe):
        rows = prints[start : start + stripe]
        stop = limits.reach(sizes, start + len(rows) - 1)
        a, b = np.nonzero(limits.linked(rows[:, None, :], prints[None, start:stop, :], np.uint64(masked)))
        a, b = a + start, b + start
        a, b = a[a < b], b[a < b]
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    return label


def _names(prints: np.ndarray) -> np.ndarray:
    """Nodes as hexadecimal text, 16 digits for each group of 64 bits."""
    return np.array(["".join(f"{x:016x}" for x in row) for row in prints.tolist()], dtype=object)


def _linked(rows: np.ndarray, starts: np.ndarray, ways: np.ndarray, prints: np.ndarray, limits: Limits, grown: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs that begin at starts: ends as rows of prints. rows: the run of each row."""
    sizes = np.diff(np.append(starts, len(rows)))
    left, right = [], []
    brief = np.repeat(sizes <= SHORT, sizes)
    for step in range(1, min(SHORT, int(sizes.max(initial=0)))):
        at = np.flatnonzero((rows[step:] == rows[:-step]) & brief[step:])
        if not len(at):
            break
        hit = at[limits.linked(prints[at], prints[at + step], ways[at])]
        left.append(hit)
        right.append(hit + step)
    for run in np.flatnonzero(sizes > SHORT):
        start, size = starts[run], sizes[run]
        run_ = prints[start : start + size]
        label = grown_roots(run_, limits) if grown else roots_of(run_, limits, int(ways[start]))
        tied = np.flatnonzero(label != np.arange(size))
        left.append(tied + start)
        right.append(label[tied] + start)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def links(nodes: DataFrame, limits: Limits, block: int = BLOCK, partitions: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(u, v), named as node_name does: links of which the components are those of all pairs of nodes within the limits.

    nodes: distinct rows of f0, f1, ... (and size). A row is filed with its columns only; what it is filed under follows
    from f0 and is computed after the shuffle.
    """
    columns = nodes.columns
    if partitions is None:
        partitions = allocated(*bit_counts(nodes), limits.tau, COMPARE_S if limits.ratio is None else COMPARE_S * BANDED)
    ways = filings(partitions)
    masked = np.array([gone for _, gone in ways], dtype=np.uint64)
    keeps = F.array(*[F.lit(signed(keep)) for keep, _ in ways])
    key = F.col("f0").bitwiseAND(F.get(keeps, F.col("way")))
    filed = nodes.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(len(ways) - 1))))
    counts = filed.select("way", key.alias("key")).groupBy("way", "key").agg(F.count(F.lit(1)).alias("n"))
    long_runs = cut(counts.filter(F.col("n") > block).select(F.col("way").alias("__way"), F.col("key").alias("__key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if long_runs.isEmpty():
        dealt = filed.withColumn("pair", F.lit(0))
    else:
        small = F.broadcast(long_runs) if long_runs.count() <= MOST_KEYS else long_runs
        own = F.pmod(F.xxhash64(F.lit("block"), *columns), F.col("blocks")).cast("int")
        ends = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
        pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), ends))
        dealt = filed.join(small, (F.col("way") == F.col("__way")) & (key == F.col("__key")), "left")
        dealt = dealt.select(*columns, "way", F.explode(pairs).alias("pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            now = now if held is None else np.concatenate([held, now])
            changed = (now[1:, :3] != now[:-1, :3]).any(axis=1)
            last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
            held = now[last:]
            yield from told(now[:last])
        if held is not None:
            yield from told(held)

    def told(now: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(now) < 2:
            return
        new = np.append(True, (now[1:, :3] != now[:-1, :3]).any(axis=1))
        found = np.ascontiguousarray(now[:, 3:]).view(np.uint64)
        left, right = _linked(np.cumsum(new), np.flatnonzero(new), masked[now[:, 0]], found, limits)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(_names(found[left])), pa.array(_names(found[right]))], ["u", "v"])

    together = dealt.repartition("way", key, "pair").select(F.col("way").cast("long").alias("way"), key.alias("key"), F.col("pair").cast("long").alias("pair"), *columns)
    return together.sortWithinPartitions("way", "key", "pair", *columns[-1:]).mapInArrow(run, "u string, v string")


def node_name(columns: list[str]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in columns])


def rooted(prints: DataFrame, columns: list[str], limits: Limits) -> DataFrame:
    """(node, root) of the fingerprints that are linked to another one."""
    return components(links(cut(prints.select(*columns).distinct()), limits))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, tau: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id, the least id of its component."""
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
    prints = cut(prints)
    named = prints.select("doc_id", node_name(["f0"]).alias("fingerprint"))
    least = cut(named.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = rooted(prints, ["f0"], Limits(tau))
    placed = least.join(roots.hint("merge"), F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least", "copies")
    placed = cut(placed)
    of_root = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    of_print = cut(with_groups(placed, of_root, "root", "prints", placed.count()).select("fingerprint", "component_id", "copies"))
    return with_groups(named, of_print, "fingerprint", "copies", prints.count()).select("doc_id", "fingerprint", "component_id")


#: near_dedup: SHINGLE words a shingle. Near copies are those whose sets of shingles have a Jaccard similarity of
#: SIMILARITY at least. Candidates share a shingle of their prefixes, which all such pairs do (see signatures), and differ
#: in DIFFER bits at most of GROUPS groups of 64. At a similarity s, acos(2s / (1 + s)) / pi of the bits differ in the
#: mean, 39 of 256 at 0.8, and up to 48 where sets have five shingles: DIFFER is so far above that it loses one such pair
#: in 10^7 at most, and one larger pair in 10^11.
#: The pigeonhole search finds those within TAU bits of the first group; pairs beyond, which no TAU that can be searched
#: holds, come from the prefixes, so that none is lost.
SHINGLE, GROUPS, DIFFER, SIMILARITY, TAU = 5, 4, 84, 0.8, 3
#: Documents that are counted to tell which shingles are common, and how many common ones are told apart.
COUNTED, MOST_COMMON = 4000, 1 << 18
#: Documents, and shingles in the mean, of a block of a candidate group.
SET_BLOCK, SET_SHINGLES = 1500, 500_000


def alike_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the place of the first of its component, where two sets are linked at that Jaccard similarity.

    A set is expanded by counting what it shares with all others over their postings. The smallest component goes on
    first; when all sets that haven't been expanded are in one component, no further link can change anything.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted, ends = owner[order], np.cumsum(np.bincount(code, minlength=len(values)))
    begins = np.concatenate([[0], ends[:-1]])
    starts = np.cumsum(sizes) - sizes
    label, waiting = np.arange(n), np.ones(n, dtype=bool)
    while True:
        left = np.flatnonzero(waiting)
        members = np.bincount(label[left], minlength=n)
        if np.count_nonzero(members) <= 1:
            return label
        i = left[np.argmin(members[label[left]])]
        waiting[i] = False
        own = code[starts[i] : starts[i] + sizes[i]]
        shared = np.bincount(posted[ranges(begins[own], ends[own] - begins[own])], minlength=n)
        near_ = np.flatnonzero(shared >= similarity * (sizes[i] + sizes - shared) - 1e-9)
        joined = np.unique(label[near_])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def verified(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): links of which the components are those of all pairs in a candidate group at that similarity.

    members: id (a string), root (the candidate group), blocks (in how many its documents fall) and hashes (the distinct
    shingles). A group is dealt out as pairs of blocks, so that no task holds more than two.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int")
    ends = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), ends)).alias("pair")
    dealt = members.select("root", pairs, "id", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for part in batches:
            u, v = [], []
            for i, key in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if key != now:
                    tied(ids, sets, u, v)
                    now, ids, sets = key, [], []
                ids.append(part.column(2)[i].as_py())
                sets.append(part.column(3)[i].values.to_numpy(zero_copy_only=False))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])
        u, v = [], []
        tied(ids, sets, u, v)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])

    def tied(ids: list[str], sets: list[np.ndarray], u: list[str], v: list[str]) -> None:
        if len(ids) > 1:
            label = alike_roots(sets, similarity)
            for i in np.flatnonzero(label != np.arange(len(ids))):
                u.append(ids[i])
                v.append(ids[label[i]])

    return dealt.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(run, "u string, v string")


def shingle_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """docs without the text, with hashes: the distinct shingle hashes of each text. A text without words has the one set {}: 0."""
    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias("__text"))
    schema = kept.drop("__text").schema.add("hashes", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            at = part.schema.get_field_index("__text")
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in part.column(at)]
            sets = [x if len(x) else np.zeros(1, dtype=np.int64) for x in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            rest = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, lists], [c for c in part.schema.names if c != "__text"] + ["hashes"])

    return kept.mapInArrow(run, schema)


def common_shingles(docs: DataFrame, text: str, shingle: int, counted: int = COUNTED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several of about `counted` documents have, ascending, and in how many of those they are."""
    share = min(1.0, counted / max(docs.count(), 1))
    some = docs.select(text) if share == 1 else docs.select(text).sample(fraction=share, seed=SEED)
    each = shingle_sets(some, text, shingle).select(F.explode("hashes").alias("h"))
    told = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "h").limit(MOST_COMMON)
    found = told.toArrow()
    h, n = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of distinct hashes the rarest ones, so many that sets of that similarity have one of them in common."""
    known, times = common
    count = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, count))][: len(hashes) - ceil(similarity * len(hashes) - 1e-6) + 1]


def signatures(docs: DataFrame, text: str, shingle: int, groups: int, similarity: float) -> DataFrame:
    """docs without the text, with f0, f1, ... and size, of the distinct shingles, and prefix.

    All sets are put in one order, shingles that are common in a sample last, others by hash. Of n shingles the first
    n - ceil(similarity * n) + 1 are the prefix: two sets that reach the similarity share max(n) * similarity shingles
    at least, so the first one they share is in both prefixes, whatever the order. The sample only makes groups small.
    """
    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias("__text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, shingle))
    names = columns_of(groups, True)
    schema = kept.drop("__text").schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("prefix", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            at = part.schema.get_field_index("__text")
            found, prefixes = np.zeros((part.num_rows, len(names)), dtype=np.uint64), []
            for i, value in enumerate(part.column(at)):
                hashes = np.unique(shingle_hashes(value.as_py(), shingle))
                hashes = hashes if len(hashes) else np.zeros(1, dtype=np.uint64)
                found[i] = [votes(mixed(hashes, g)) for g in range(groups)] + [len(hashes)]
                prefixes.append(prefix_of(hashes.view(np.int64), common.value, similarity))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
            rest = [c for i, c in enumerate(part.columns) if i != at]
            columns = rest + [pa.array(found[:, k].copy().view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, lists], [c for c in part.schema.names if c != "__text"] + names + ["prefix"])

    return kept.mapInArrow(run, schema)


def grown_roots(prints: np.ndarray, limits: Limits) -> np.ndarray:
    """roots_of for rows of which most are near to each other: as in alike_roots, the smallest component grows first."""
    n = len(prints)
    label, waiting = np.arange(n), np.ones(n, dtype=bool)
    while True:
        left = np.flatnonzero(waiting)
        members = np.bincount(label[left], minlength=n)
        if np.count_nonzero(members) <= 1:
            return label
        i = left[np.argmin(members[label[left]])]
        waiting[i] = False
        joined = np.unique(label[limits.linked(prints[i], prints, np.uint64(0))])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def prefix_links(nodes: DataFrame, limits: Limits, block: int = BLOCK) -> DataFrame:
    """(u, v): links of which the components are those of all pairs of nodes that share a shingle of their prefixes and are within the limits.

    nodes: node (a long), f0, f1, ..., size and prefix. Only the shingles of several nodes meet the fingerprints.
    """
    columns = [c for c in nodes.columns if c not in ("node", "prefix")]
    filed = nodes.select("node", F.explode("prefix").alias("key"))
    several = cut(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = passing(filed, F.xxhash64("key"), filter_of(several.select(F.xxhash64("key"))), "shared").filter("shared").drop("shared")
    shared = with_groups(shared, several, "key", "n", several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).cast("int")
    ends = lambda other: F.least(own, other) * blocks + F.greatest(own, other)
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), ends)).alias("pair")
    dealt = shared.join(nodes.select("node", *columns).hint("merge"), "node").select("key", pairs, "node", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            now = now if held is None else np.concatenate([held, now])
            changed = (now[1:, :2] != now[:-1, :2]).any(axis=1)
            last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
            held = now[last:]
            yield from told(now[:last])
        if held is not None:
            yield from told(held)

    def told(now: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(now) < 2:
            return
        new = np.append(True, (now[1:, :2] != now[:-1, :2]).any(axis=1))
        found = np.ascontiguousarray(now[:, 3:]).view(np.uint64)
        left, right = _linked(np.cumsum(new), np.flatnonzero(new), np.zeros(len(now), np.uint64), found, limits, grown=True)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(now[left, 2]), pa.array(now[right, 2])], ["u", "v"])

    together = dealt.repartition("key", "pair").select("key", F.col("pair").cast("long").alias("pair"), "node", *columns)
    return together.sortWithinPartitions("key", "pair").mapInArrow(run, "u long, v long")


def near_links(prints: DataFrame, limits: Limits) -> DataFrame:
    """(u, v): links by the pigeonhole search, between the nodes of prints (node, f0, f1, ..., size), those of equal fingerprints included."""
    columns = [c for c in prints.columns if c != "node"]
    named = prints.select("node", node_name(columns).alias("print"))
    least = cut(named.groupBy("print").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("copies")))
    of = lambda end: least.select(F.col("print").alias(end), F.col("least").alias(f"{end}_node")).hint("merge")
    apart = links(cut(prints.select(*columns).distinct()), limits).join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    alike = with_groups(named, least.filter("copies > 1"), "print", "copies", named.count()).filter(F.col("node") != F.col("least"))
    return apart.unionByName(alike.select(F.col("node").alias("u"), F.col("least").alias("v")))


@any_columns("doc_id", "text")
def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, groups: int = GROUPS, differ: int = DIFFER, similarity: float = SIMILARITY, tau: int = TAU) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: of each component of near copies the row with the least id.

    Candidates come from the fingerprints' pigeonhole search and, exactly for the rest, from shared prefixes; all are verified.
    Null ids come last; equal ids of a component are told apart by a hash of the whole row, and identical rows, which
    are equals in every column, count as one until one of them is taken. Texts are read four times, once only a sample,
    the last two times only those of candidates and of rows that stay; they are shuffled only if over MOST_KEYS rows are
    candidates, and then only theirs.
    """
    columns = docs.columns
    key = F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(F.xxhash64(*columns)))
    marked = docs.withColumn("__key", key)
    of_text = marked.select("__key", F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    prints = cut(signatures(of_text, "__t", shingle, groups, similarity).withColumn("node", F.monotonically_increasing_id()))
    near = near_links(prints.drop("__key", "__id", "prefix"), Limits(tau, differ, similarity))
    rest = prefix_links(prints.drop("__key", "__id"), Limits(64, differ, similarity))
    roots = components(near.unionByName(rest)).withColumnRenamed("node", "of")
    # rows that are equal in all columns are always linked, so those are among the candidates too
    found = prints.select("__key", "__id", "size", "node").join(roots.hint("merge"), F.col("node") == F.col("of"))
    found = cut(found.groupBy("__key").agg(F.first("root").alias("root"), F.min("__id").alias("__id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("equals")))
    held = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / SET_BLOCK), F.ceil(F.col("m") / SET_SHINGLES)).cast("int")
    candidates = cut(with_groups(found, cut(held.select("root", blocks.alias("blocks"), "n")), "root", "n", found.count()))
    chosen = matching(of_text, candidates.select(F.col("__key").alias("__of"), "root", "blocks"), "__key", "inner")
    twice = candidates.filter("equals > 1").select(F.col("__key").alias("__of"))
    some_twice = not twice.isEmpty()
    if some_twice:
        chosen = chosen.groupBy("__key").agg(*[F.first(c).alias(c) for c in ("root", "blocks", "__t")])
    sets = shingle_sets(chosen.select(F.col("__key").alias("id"), "root", "blocks", "__t"), "__t", shingle)
    groups_of = components(verified(sets, similarity))
    ranked = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("node").alias("key"))
    tied = groups_of.join(candidates.select("__key", "__id").hint("merge"), F.col("node") == F.col("__key"))
    stay = tied.groupBy("root").agg(F.min(ranked)["key"].alias("stays")).select("stays")
    goes = cut(tied.join(stay.hint("merge"), F.col("node") == F.col("stays"), "left_anti").select(F.col("node").alias("__of")))
    kept = matching(marked, goes, "__key", "left_anti")
    if not some_twice:
        return kept.select(*columns)
    one = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__one")
    once = matching(kept, twice, "__key", "left_semi").groupBy("__key").agg(one).select("__one.*")
    return matching(kept, twice, "__key", "left_anti").select(*columns).unionByName(once)
