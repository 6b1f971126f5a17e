"""Vector code compression: product codes, whose nearest entries are found by a VA-file over each codebook.

Vectors are cut into equal parts; each part has a codebook of entries, and a vector's code is the index of the nearest
entry (squared Euclidean distance of integers, ties to the lower index) for each part. Codebooks are refined in rounds:
all vectors are assigned, and an entry becomes the floored mean of the parts that it was nearest to.

The search for the nearest entry. An entry's coordinates are quantised to BITS bits: a cell of a coordinate spans the
least to the greatest of the entries' values that fall in it. For a query, a lookup table by coordinate and cell holds
the least and the greatest squared difference; their sums over an entry's cells bound its distance from below and above.
Only entries whose lower bound does not exceed the least upper bound are candidates, and only for those are distances
computed, in integers. Bounds are sums of 32-bit floats, widened by SLACK, which exceeds any rounding, so they lose nothing.

At scale. Vectors are scaled and packed once, written to the shared folder, and read once a round in Arrow batches. What
leaves a task of a round is a count and a sum for each entry, at most parts * entries rows whatever it has read; they are
added up by Spark, and the driver holds the codebooks only (parts * entries * width integers). No row is shuffled but to
add up the errors of a label, before which they are summed where they are.

Defined cases: rows whose vector is null or empty or has a null or non-finite component are left out, as are those whose
vector is not as long as that of the row with the least id (null ids last, then by vector); that length must be a
multiple of the number of parts; integers beyond +-2^27 count as that; with fewer rows than entries the codebooks are as
much smaller; rows with equal ids are rows like others, and among the first entries come in the order of their vectors;
rows that are equal get equal codes; null labels form a group; an empty table gives an empty result; further columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import cut, with_groups
from fernweave.llm.vectors import matrix, of_one_length, packed, stored

#: Bits of a quantised coordinate of an entry.
BITS = 4
#: By how much bounds are widened; sums of up to 1,000 rounded terms differ by less.
SLACK = 1e-4
#: Queries whose bounds are held at a time.
QUERIES = 2048


class VaFile:
    """The entries of a codebook (entries x width), searched through cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = min(1 << bits, n)
        order = np.sort(entries, axis=0)
        edges = order[(np.arange(1, cells) * n) // cells]  # values from which the next cell begins: as many entries each
        cell = (entries[:, None, :] >= edges[None, :, :]).sum(axis=1)
        inside = cell[:, None, :] == np.arange(cells)[None, :, None]
        # an empty cell (ties) is in no entry, so any bound will do
        self.least = np.where(inside, entries[:, None, :], np.iinfo(np.int64).max).min(axis=0)
        self.most = np.where(inside, entries[:, None, :], np.iinfo(np.int64).min).max(axis=0)
        empty = self.least > self.most
        self.least[empty] = self.most[empty] = 0
        # which place of a lookup table (coordinate by cell) an entry's bound takes: sums of them are products with it
        self.chosen = np.zeros((width * cells, n), dtype=np.float32)
        for d in range(width):
            self.chosen[d * cells + cell[:, d], np.arange(n)] = 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries."""
        below, above = (queries[:, :, None] - edge.T[None] for edge in (self.least, self.most))
        nearest = np.maximum(np.maximum(-below, above), 0)
        farthest = np.maximum(np.abs(below), np.abs(above))
        lower, upper = ((x.astype(np.float64) ** 2).astype(np.float32).reshape(len(queries), -1) @ self.chosen for x in (nearest, farthest))
        return lower * (1 - SLACK), upper * (1 + SLACK)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each query."""
        at, error = np.empty(len(queries), dtype=np.int64), np.empty(len(queries), dtype=np.int64)
        for start in range(0, len(queries), QUERIES):
            part = queries[start : start + QUERIES]
            lower, upper = self.bounds(part)
            rows, entries = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
            distance = ((part[rows] - self.entries[entries]) ** 2).sum(axis=1)
            first = np.searchsorted(rows, np.arange(len(part)))
            least = np.minimum.reduceat(distance, first)
            ties = np.flatnonzero(distance == least[rows])
            _, kept = np.unique(rows[ties], return_index=True)  # candidates of a query are in the order of their index
            at[start : start + QUERIES], error[start : start + QUERIES] = entries[ties[kept]], least
        return at, error


def _parts(ints: pa.Array, books: np.ndarray) -> np.ndarray:
    """rows x parts x width"""
    return matrix(ints, books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])


def refined(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows of ints."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(book) for book in books]
        count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            rows = _parts(batch.column(0), books)
            for p in range(parts):
                at, _ = files[p].nearest(rows[:, p])
                count[p] += np.bincount(at, minlength=entries)
                for d in range(width):  # sums of a batch are exact in doubles
                    total[p, :, d] += np.bincount(at, weights=rows[:, p, d], minlength=entries).astype(np.int64)
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    found = ints.select("ints").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(width)])
    new = books.copy()
    for row in added.collect():  # parts * entries rows at most
        new[row["part"], row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return new


def codebooks(ints: DataFrame, length: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """parts x entries x width, from rows (id, ints) of that length: the parts of the rows with the least ids, refined in rounds over all rows."""
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    head = ints.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    books = matrix(pa.array([bytes(row["ints"]) for row in head], pa.binary()), length).reshape(len(head), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(ints, books)
    return books


def encoded(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """ints with code (two hex digits or more for each part) and error in place of the vector."""
    from pyspark.sql.pandas.types import to_arrow_schema

    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    schema = ints.drop("ints").schema.add("code", "string").add("error", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(book) for book in books]
        for batch in batches:
            k = batch.schema.get_field_index("ints")
            rows = _parts(batch.column(k), books)
            found = [files[p].nearest(rows[:, p]) for p in range(len(files))]
            code = ["".join(f"{x:0{digits}x}" for x in of) for of in zip(*(at.tolist() for at, _ in found), strict=True)]
            kept = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.string()), pa.array(sum(error for _, error in found), pa.int64())], arrow.names)

    return ints.mapInArrow(run, schema)


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with `ints`, the integer vector that the code stands for."""
    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    index = lambda p: F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int")
    return codes.withColumn("ints", F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), index(p)) for p in range(len(books))])))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) for each row that has a usable vector, and the codebooks."""
    ints = stored(packed(rows, F.col(f"`{vector}`"), scale, id=F.col(f"`{vec_id}`"), label=F.col(f"`{label}`")), "codes")
    ints, length = of_one_length(ints, [F.col("id").asc_nulls_last(), F.col("ints")])
    books = codebooks(ints, length, parts, entries, rounds) if length else np.empty((parts, 0, 0), dtype=np.int64)
    if not length:
        return ints.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    told = encoded(ints, books).withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    told = cut(told)
    groups = told.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    return with_groups(told, cut(groups), "__label", "__n", told.count()).drop("__label", "__n"), books
