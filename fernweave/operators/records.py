"""Rows of tables after more rows came in, by natural keys: the batch form of upserts.

Each gives the same table however often the same rows come in, and in whatever order files are read: where order
decides, it is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(table: DataFrame, more: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table and those rows of more whose key it lacks; of several with one key the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = more.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
    on = [table[k].eqNullSafe(fresh[k]) for k in keys]
    return table.unionByName(fresh.join(table, on, "left_anti").select(*table.columns))


def latest_wins(table: DataFrame, more: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with every row replaced by the last one of its key in more, in all columns, nulls too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    last = more.withColumn("__rank", rank).filter("__rank = 1").select(*table.columns)
    on = [table[k].eqNullSafe(last[k]) for k in keys]
    return table.join(last, on, "left_anti").unionByName(last)


def declared_following(nodes: DataFrame, told: DataFrame, profiles: DataFrame) -> DataFrame:
    """nodes with what each account says it follows: by its own page, else by its stored profile, else as it was."""
    by_page = told.select("task_id", "account_id", F.col("declared").alias("__page"))
    by_profile = profiles.select("task_id", "account_id", F.col("following_count").alias("__profile"))
    rows = nodes.join(by_page, ["task_id", "account_id"], "left").join(by_profile, ["task_id", "account_id"], "left")
    found = F.coalesce("__page", "__profile", "declared_following")
    asked = F.col("__asked")
    rows = rows.join(told.select("task_id", "account_id", F.lit(True).alias("__asked")), ["task_id", "account_id"], "left")
    return rows.withColumn("declared_following", F.when(asked, found).otherwise(F.col("declared_following"))).select(*nodes.columns)
