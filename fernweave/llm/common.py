"""Helpers that the training-data operators share: words, ASCII folding, joins that no key makes hot, Arrow slices."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir"]

#: Keys up to which a table of keys is broadcast (some 50 bytes each).
MOST_KEYS = 1_000_000
#: A key is hot if it has over LEAST_HOT rows and over one in MOST_HOT of all rows, so there are MOST_HOT hot keys at most.
LEAST_HOT, MOST_HOT = 1_000, 500_000
#: Bits of a filter for each key, and at most (2^31 are 256 MB); bits of one of its blocks.
BITS_A_KEY, MOST_BITS, BLOCK_BITS = 16, 1 << 31, 1 << 14

# The white space that parts words, and the ASCII letters that are folded.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def any_columns(*roles: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """An operator whose table may have further columns of any name, also such as it uses itself or as hold dots.

    It sees the columns that its parameters `roles` name (or that are roles, where it has no such parameter); the others
    are given names that no operator uses, and their own again in its result, unless one of its output columns has that name.
    """

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(docs: DataFrame, *args: object, **named: object) -> DataFrame:
            bound = signature.bind(docs, *args, **named)
            bound.apply_defaults()
            own = {bound.arguments.get(role, role) for role in roles}
            further = {name if name in own else f"further column {i}": name for i, name in enumerate(docs.columns)}
            out = operator(docs.toDF(*further), *args, **named)
            new = {name for name in out.columns if name not in further}
            told = [name for name in out.columns if name in new or further[name] not in new]
            return out.select(*[F.col(f"`{name}`") for name in told]).toDF(*[further.get(name, name) for name in told])

        return run

    return around


def text_or_empty(text: Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of ASCII only take Spark's quick lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that is not null, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared checkpoint folder and read back: like cut(), with columns that can be left out."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hot_from(rows: int) -> int:
    """Rows of a key above which it is hot among so many rows."""
    return max(LEAST_HOT, rows // MOST_HOT)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of groups, which has a row for each value of key, and in `size` how many rows have it.

    Hot keys (there are MOST_HOT at most, by their definition) meet their rows by a broadcast, where the rows are; what
    is shuffled has no hot key. Rows whose key is in no group are left out. total: number of rows.
    """
    limit = hot_from(total)
    of = groups.select(F.col(key).alias("__of"), F.struct(*[c for c in groups.columns if c != key]).alias("__group"), F.col(size).alias("__rows"))
    hot, cold = of.filter(F.col("__rows") > limit).drop("__rows"), of.filter(F.col("__rows") <= limit).drop("__rows")
    told = [*[F.col(c) for c in rows.columns], F.col("__group.*")]
    if hot.isEmpty():
        return rows.join(cold, F.col(key) == F.col("__of")).select(*told)
    flagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__of"), "left")
    met = flagged.filter(F.col("__of").isNotNull()).select(*told)
    rest = flagged.filter(F.col("__of").isNull()).drop("__of", "__group")
    return met.unionByName(rest.join(cold, F.col(key) == F.col("__of")).select(*told))


def filter_of(keys: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(block, words), bits: a filter of the 64-bit hashes in the only column of keys; blocks of bits as arrays of longs.

    It has BITS_A_KEY bits for each key but never more than most_bits, which bounds what is broadcast. A hash of keys
    always passes; of other hashes a share of 1 - exp(-keys / bits) passes too.
    """
    h = F.col(keys.columns[0])
    wanted = 1 << max(keys.count() * BITS_A_KEY - 1, 1).bit_length()
    bits = max(BLOCK_BITS, min(wanted, most_bits))
    words = BLOCK_BITS // 64
    place = F.pmod(h, F.lit(bits))
    held = keys.select(F.floor(place / 64).alias("word"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit"))
    held = held.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("mask"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(held, "word", "left")
    pair = F.struct(F.col("word"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    blocks = every.groupBy(F.floor(F.col("word") / words).alias("block")).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    return cut(blocks.select("block", F.transform("pairs", lambda p: p["mask"]).alias("words"))), bits


def passing(rows: DataFrame, hashed: Column, table: tuple[DataFrame, int], name: str) -> DataFrame:
    """rows with the boolean `name`: whether the 64-bit hash passes the filter. Nothing of rows is shuffled."""
    blocks, bits = table
    place = F.pmod(hashed, F.lit(bits))
    found = rows.join(F.broadcast(blocks.select(F.col("block").alias("__block"), F.col("words").alias("__words"))), F.floor(place / BLOCK_BITS) == F.col("__block"), "left")
    bit = F.getbit(F.get("__words", F.floor(place % BLOCK_BITS / 64).cast("int")), (place % 64).cast("int"))
    return found.select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(name))


def matching(rows: DataFrame, keys: DataFrame, key: str, how: str, most_keys: int | None = None) -> DataFrame:
    """rows joined to keys, whose first column holds each key once; how: inner, left_semi or left_anti.

    The keys are broadcast if they are few. Where they aren't, only the rows that pass a filter of them are shuffled:
    those that have a partner, and a small share of the others.
    """
    of = keys.columns[0]
    on = F.col(key) == F.col(of)
    if keys.count() <= (MOST_KEYS if most_keys is None else most_keys):
        return rows.join(F.broadcast(keys), on, how)
    flagged = passing(rows, F.xxhash64(key), filter_of(keys.select(F.xxhash64(of))), "__maybe")
    joined = flagged.filter("__maybe").drop("__maybe").join(keys, on, how)
    return joined if how != "left_anti" else joined.unionByName(flagged.filter("not __maybe").drop("__maybe"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about most_bytes of `column`; a longer single row is a piece of its own.

    Python objects made from a piece are what an operator holds at a time, however many rows Arrow delivers at once.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 8
        if start < len(sizes):
            yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
