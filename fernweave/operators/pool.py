"""Reports on a pool of accounts that collect: totals, locks by queue, and one line for each account. No credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_stats(accounts: DataFrame, as_of: str) -> DataFrame:
    """(name, n): total, active and inactive accounts, and for each queue the accounts that it locks at as_of."""
    totals = accounts.agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"))
    named = totals.select(F.explode(F.create_map(*[x for c in ("total", "active", "inactive") for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    locks = accounts.select(F.explode("locks").alias("queue", "until"))
    held = locks.groupBy(F.concat(F.lit("locked_"), F.col("queue")).alias("name")).agg(F.count_if(F.col("until") > F.lit(as_of).cast("timestamp")).alias("n"))
    return named.unionByName(held)


def account_info(accounts: DataFrame) -> DataFrame:
    """Accounts, active ones first, then by last use (only where there were requests), then by name; place is the order."""
    total = F.aggregate(F.map_values("stats"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = accounts.select("username", F.col("has_session").alias("logged_in"), "login_method", "active", "last_used", total.alias("total_req"), F.left(F.coalesce("error_msg", F.lit("None")), F.lit(60)).alias("error_msg"))
    used = F.when(F.col("total_req") > 0, F.coalesce(F.col("last_used"), F.timestamp_seconds(F.lit(0)))).otherwise(F.timestamp_seconds(F.lit(0)))
    return rows.orderBy(F.col("active").desc(), used.desc(), F.lower("username"))


def counters(events: DataFrame, properties: list[str]) -> DataFrame:
    """How often each combination of properties came up."""
    return events.groupBy(*properties).agg(F.count(F.lit(1)).alias("n"))
