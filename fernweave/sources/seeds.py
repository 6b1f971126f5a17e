"""Pasted seed lists: handles, URLs and stray white space into handles, with what was left out and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a handle is made of.
HANDLE = "^[A-Za-z0-9_]{1,15}$"
_LINE_ENDS = "[,\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def seed_lines(lists: DataFrame, raw: str = "raw") -> DataFrame:
    """lists without `raw`, once for each entry that isn't blank: place, line, handle, status.

    status: valid, duplicate (of an earlier one, whatever its case) or invalid; handle is null for invalid ones.
    """
    keys = [c for c in lists.columns if c != raw]
    space = "^\\s+|\\s+$"
    lines = lists.select(*keys, F.posexplode(F.split(F.col(raw), _LINE_ENDS)).alias("place", "line")).withColumn("line", F.regexp_replace("line", space, "")).filter("line <> ''")
    tail = F.substring_index(F.substring_index("line", "/", -1), "?", 1)
    named = F.regexp_replace(F.regexp_replace(tail, "^@", ""), space, "")
    rows = lines.withColumn("handle", F.when(named.rlike(HANDLE), named))
    earlier = F.row_number().over(Window.partitionBy(*keys, F.lower("handle")).orderBy("place"))
    status = F.when(F.col("handle").isNull(), "invalid").when(earlier > 1, "duplicate").otherwise("valid")
    return rows.withColumn("status", status)


def seed_import(lists: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each list that has entries: handles, duplicates, invalid (each in the order given), total_lines, valid_count."""
    keys = [c for c in lists.columns if c != raw]
    by = lambda status, value: F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == status, F.struct("place", F.col(value).alias("v"))))), lambda x: x["v"])
    parts = [by("valid", "handle").alias("handles"), by("duplicate", "handle").alias("duplicates"), by("invalid", "line").alias("invalid"), F.count(F.lit(1)).alias("total_lines")]
    return seed_lines(lists, raw).groupBy(*keys).agg(*parts).withColumn("valid_count", F.size("handles"))
