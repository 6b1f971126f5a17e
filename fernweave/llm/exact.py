"""Exact dedup by progressive refinement: by length, then by a hash of the prefix, then by a hash of the full text.

Texts are equal when identical after lower-casing A-Z. Lengths that two rows or more have are counted over all rows; of
rows with such a length the prefix is hashed, and (length, prefix hash) pairs that two rows or more have are counted
likewise; only rows with such a pair take a full hash. Counts are made before the shuffle. What comes back to the texts
is a filter of bits, bounded in size, so no text is shuffled to decide who takes a full hash; rows that pass a filter
by chance take a full hash too and turn out to be alone. The same steps are taken at every size.

Defined cases: a null text counts as empty, and all empty texts are equal; a text of any length is hashed whole; of
equal texts the row with the largest id stays (a null id is the least), and of equal ids in a group the one with the
largest hash of its columns; of rows that are equal in all columns exact_dedup keeps one, while exact_groups calls each
row kept that has the group's id; ids may be of any type that has an order; an empty table gives an empty result;
further columns pass through exact_dedup, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import MOST_BITS, any_columns, cut, filter_of, fold_ascii, matching, passing, text_or_empty, with_groups

#: Code points of the prefix that is hashed in the second step.
PREFIX = 64


def _shared(hashes: DataFrame) -> DataFrame:
    """Hashes (the only column) that two rows or more have."""
    name = hashes.columns[0]
    return cut(hashes.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(name))


def refined(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """docs with __full: sha256 of the folded text, null where no other row can have the row's length and prefix hash."""
    t = text_or_empty(F.col(text))
    length = F.xxhash64(F.octet_length(t))
    lengths = filter_of(_shared(docs.select(length.alias("__h"))), most_bits)
    of_length = passing(docs, length, lengths, "__again")
    prefix = F.xxhash64(F.octet_length(t), fold_ascii(F.substring(t, 1, PREFIX)))
    prefixes = filter_of(_shared(of_length.filter("__again").select(prefix.alias("__h"))), most_bits)
    of_prefix = passing(of_length, F.when(F.col("__again"), prefix), prefixes, "__too")
    return of_prefix.withColumn("__full", F.when(F.col("__too"), F.sha2(fold_ascii(t), 256))).drop("__again", "__too")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept (and text_sha256 for every row, if digest)."""
    t = text_or_empty(F.col(text))
    extra = [F.coalesce(F.col("__full"), F.sha2(fold_ascii(t), 256)).alias("text_sha256")] if digest else []
    rows = refined(docs.select(doc_id, text), text, most_bits).select(F.col(doc_id).alias("doc_id"), "__full", *extra)
    rows = cut(rows)  # ids and hashes only; the texts have been read
    shared = rows.filter(F.col("__full").isNotNull())
    groups = cut(shared.groupBy("__full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = with_groups(shared, groups, "__full", "group_size", shared.count()).drop("__full")
    alone = rows.filter(F.col("__full").isNull()).drop("__full").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()))


@any_columns("doc_id", "text")
def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, most_keys: int | None = None) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with the columns of docs.

    Who goes is decided on hashes: a row is told by its group, its id and the hash of all its columns. What goes is then
    left out of docs, by a broadcast if it is little; else by a join for which only the rows are shuffled that go, and
    the small share of the others that the filter lets through. Rows that are equal in all columns are one until a copy
    of them is taken.
    """
    columns = docs.columns
    row = F.sha2(F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.hex(F.xxhash64(*columns)), F.hex(F.hash(*columns))), 224)
    told = refined(docs.withColumn("__row", row), text, most_bits).filter(F.col("__full").isNotNull())
    told = cut(told.groupBy("__full", "__row").agg(F.first(F.col(doc_id)).alias("__id"), F.count(F.lit(1)).alias("__copies")))
    rank = F.struct(F.col("__id").isNotNull(), F.col("__id"), F.col("__row"))
    groups = cut(told.groupBy("__full").agg(F.max(rank)["__row"].alias("__stays"), F.count(F.lit(1)).alias("__rows")))
    placed = cut(with_groups(told, groups, "__full", "__rows", told.count()))
    goes = placed.filter(F.col("__row") != F.col("__stays")).select(F.col("__row").alias("__key"))
    marked = docs.withColumn("__row", row)
    stay = matching(marked, goes, "__row", "left_anti", most_keys)
    twice = placed.filter((F.col("__row") == F.col("__stays")) & (F.col("__copies") > 1)).select(F.col("__row").alias("__key"))
    if twice.isEmpty():
        return stay.select(*columns)
    copies = matching(stay, twice, "__row", "left_semi", most_keys)
    one = copies.groupBy("__row").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__one")).select("__one.*")
    return matching(stay, twice, "__row", "left_anti", most_keys).select(*columns).unionByName(one)
