"""Vectors of integers, as the operators on embeddings share them: scaled, floored and packed once, read as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import rewritten

#: Integers beyond +-LARGEST count as that, so that squared distances of 64 and more of them have room in a long.
LARGEST = 1 << 27


def packed(rows: DataFrame, vector: Column, scale: int, **columns: Column) -> DataFrame:
    """The given columns and `ints`, floor(scale * x) of each component x as a double, as 32-bit integers in order.

    Rows go whose vector is null or empty or holds a null or non-finite component.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    chosen = rows.select(*[c.alias(name) for name, c in columns.items()], vector.cast("array<double>").alias("__vector"))
    schema = chosen.drop("__vector").schema.add("ints", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__vector")
            held = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = held.flatten().to_numpy(zero_copy_only=False)  # nulls come as NaN
            finite = np.isfinite(x)
            faults = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~finite], minlength=len(sizes))
            whole = np.clip(np.floor(np.where(finite, x, 0.0) * scale), -LARGEST, LARGEST).astype("<i4")
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 4
            ints = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(whole)]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), ints], arrow.names)
            yield out.filter(pa.array((sizes > 0) & (faults == 0)))

    return chosen.mapInArrow(run, schema)


def of_one_length(ints: DataFrame, first: list[Column]) -> tuple[DataFrame, int]:
    """The rows whose vector is as long as that of the row that is first in order; that length, 0 if there is no row."""
    head = ints.orderBy(*first).select(F.octet_length("ints").alias("n")).first()
    n = head["n"] if head else 0
    return ints.filter(F.octet_length("ints") == n), n // 4


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The packed vectors of a column (none is null) as rows of a matrix."""
    if not len(column):
        return np.empty((0, width), dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), width).astype(np.int64)


def stored(ints: DataFrame, name: str) -> DataFrame:
    """The packed rows, written once in the shared folder, so that the rounds that follow read no lists of floats."""
    return rewritten(ints, name)
