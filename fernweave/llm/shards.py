"""Sharding by weighted rendezvous hashing of stable record keys.

Every key draws a number u from the hash of (key, shard) for each shard; the shard with the least -ln(u) / weight gets
the record. A new shard can only win records for itself, so nothing moves between the old ones. Which shard a record is
in depends on its key and the shards only.

Slots number the records of a shard from 0 without gaps, in the order of (bucket, key, size, crc). Records fall into
2^BUCKET_BITS buckets by a hash of key and crc; identical records are counted before the shuffle, buckets are numbered
among themselves and records within their bucket, so no task sees a whole shard.

Defined cases: a null key is hashed as its own key; a null text has no bytes (size 1) and the crc of the empty text;
identical records get consecutive slots; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import text_or_empty

SHARDS = 8
BUCKET_BITS = 12


def _draw(text: Column) -> Column:
    """52 bits of the md5 of text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) shards. With equal weights the greatest draw wins, which is the same rule."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    equal = len(set(weights)) == 1
    scored = []
    for shard, weight in enumerate(weights):
        draw = _draw(F.concat(name, F.lit(f"/{shard}")))
        score = draw.cast("double") if equal else F.log((draw + 0.5) / float(1 << 52)) / float(weight)
        scored.append(F.struct(score.alias("s"), F.lit(-shard).alias("k")))
    return -(F.array_max(F.array(*scored))["k"]) if len(scored) > 1 else F.lit(0)


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown: float = 1.0) -> DataFrame:
    """docs with size, text_crc32, shard and grown_shard (the shard when one more of weight `grown` is added)."""
    weights = [1.0] * SHARDS if weights is None else weights
    t = text_or_empty(F.col(text))
    key = F.col(doc_id)
    return docs.withColumns({"size": F.octet_length(t).cast("long") + 1, "text_crc32": F.crc32(t), "shard": shard_of(key, weights).cast("int"), "grown_shard": shard_of(key, [*weights, grown]).cast("int")})


def with_slots(records: DataFrame) -> DataFrame:
    """records (doc_id, size, text_crc32, shard, grown_shard) with slot; only these columns."""
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    bucket = (_draw(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))) % (1 << BUCKET_BITS)).cast("int")
    counted = records.select(*columns, bucket.alias("bucket")).groupBy("bucket", *columns).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = counted.withColumn("upto", F.sum("n").over(within))
    # 2^BUCKET_BITS rows of a shard at most.
    buckets = records.select("shard", bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(starts, ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("upto") - F.col("n"))
    return numbered.select(*columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    found = assigned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), weights=weights).drop("text")
    out = with_slots(found)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", weights: list[float] | None = None) -> None:
    """The rows of docs as Parquet under path, in a folder for each shard; rows stay in the task that read them."""
    name = F.col(doc_id)
    docs.withColumn("shard", shard_of(name, [1.0] * SHARDS if weights is None else weights).cast("int")).write.partitionBy("shard").parquet(path)
