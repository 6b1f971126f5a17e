"""Deep pages of an ordered list: rows are put in order once, and a page at any offset reads the ranges that hold it.

The order is cut into ranges by Spark's range partitioning and each range is sorted where it lies; how many rows come before a
range follows from the ranges' counts. A page is then a few places in one range or two neighbouring ones, whose files alone
are read, and the list's total is known. Without an index a page at offset n sorts n rows at least in every task and on the
way to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range holds in the mean.
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Page:
    """A page's rows in order, with their places from 0 in `place`; the list's total, and whether rows follow the page."""

    rows: DataFrame
    total: int
    limit: int
    offset: int

    @property
    def truncated(self) -> bool:
        return self.offset + self.limit < self.total


class RankIndex:
    """A list in order under a path. The order must be total, so that a row has one place."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        told = spark.read.parquet(f"{path}/ranges").orderBy("range").collect()  # a row for each range, and one that tells the schema
        self.stored = spark.read.schema(T.StructType.fromJson(json.loads(told[0]["told"]))).parquet(f"{path}/rows")
        self.before, total = {}, 0
        for r in told[1:]:
            self.before[r["range"]] = (total, r["n"])
            total += r["n"]
        self.total = total

    @classmethod
    def build(cls, rows: DataFrame, order: list[Column], path: str, range_rows: int = RANGE_ROWS) -> RankIndex:
        """Put the rows in order, once: one shuffle, one sort of each range."""
        spark = rows.sparkSession
        ranges = max(1, -(-rows.count() // range_rows))
        dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
        placed = dealt.withColumns({"range": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
        placed.write.partitionBy("range").parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        counts = stored.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("told", F.lit(None).cast("string"))
        schema = spark.createDataFrame([(-1, 0, json.dumps(placed.schema.jsonValue()))], "range int, n long, told string")
        counts.unionByName(schema).coalesce(1).write.parquet(f"{path}/ranges")
        return cls(spark, path)

    def page(self, limit: int, offset: int = 0) -> Page:
        """The rows from place `offset` on; files of other ranges are not read."""
        if limit < 1 or offset < 0:
            raise ValueError("a page has a row at least and begins at row 0 or later")
        held = [k for k, (first, n) in self.before.items() if first < offset + limit and first + n > offset]
        start = F.lit(0).cast("long")
        for k in held:
            start = F.when(F.col("range") == k, F.lit(self.before[k][0])).otherwise(start)
        rows = self.stored.filter(F.col("range").isin(held)).withColumn("place", start + F.col("__at"))
        rows = rows.filter((F.col("place") >= offset) & (F.col("place") < offset + limit)).drop("range", "__at")
        return Page(rows, self.total, limit, offset)
