"""Why chains of pages stopped, replayed over captured pages by windows: one row for each chain.

A chain is the pages of one (task, account, operation) in the order of page_no. Rules are read off each page and what
came before it; the first page that meets one ends the chain, and pages after it count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHAIN = ["task_id", "account_id"]
EMPTY_LIMIT = 3
MAX_EXPANSION_PAGES, MAX_TIMELINE_PAGES = 40, 12
TARGET_POSTS, MAX_SCANNED = 30, 200
#: Pages that a task is dealt in the mean, when there are more than its share of the shuffle partitions.
PAGES_A_TASK = 500_000


def _dealt(pages: DataFrame, by: str) -> DataFrame:
    """pages with all of a chain in one partition, since its `by` is; a partition gets PAGES_A_TASK at most in the mean.

    The number is given, as pages shuffle to so few bytes that partitions would be merged into ones of millions of pages.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(parts, -(-pages.count() // PAGES_A_TASK)), by)


def _upto(chain: list[str]) -> WindowSpec:
    """The pages of a chain up to the current one. Windows over it share one sort."""
    return Window.partitionBy(*chain).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)


def _with_again(pages: DataFrame, chain: list[str]) -> DataFrame:
    """pages with cursor_again: seen on an earlier page. Sorts by cursors, so it comes before what goes by pages."""
    again = F.row_number().over(Window.partitionBy(*chain, "cursor_out").orderBy("page_no")) > 1
    return pages.withColumn("cursor_again", F.col("cursor_out").isNotNull() & again)


def _with_history(pages: DataFrame, chain: list[str], size: str) -> DataFrame:
    """pages with n (1, 2, ...) and empty_run (empty pages in a row up to here)."""
    upto = _upto(chain)
    rows = pages.withColumns({"n": F.row_number().over(upto), "__empty": F.count_if(F.col(size) == 0).over(upto)})
    at_full = F.coalesce(F.max(F.when(F.col(size) > 0, F.col("__empty"))).over(upto), F.lit(0))
    return rows.withColumn("empty_run", F.col("__empty") - at_full).drop("__empty")


def _first_end(rows: DataFrame, chain: list[str], reason: Column, extra: list[Column]) -> DataFrame:
    told = rows.withColumn("__reason", reason)
    ended = F.count("__reason").over(_upto(chain).rowsBetween(Window.unboundedPreceding, -1))
    kept = told.withColumn("__ended", ended).filter("__ended = 0")
    return kept.groupBy(*chain).agg(F.count(F.lit(1)).alias("pages"), F.max("__reason").alias("reason"), *extra)


def _page_end() -> Column:
    empty = F.when(F.col("empty_run") >= EMPTY_LIMIT, "empty_pages")
    return empty.when(F.col("cursor_out").isNull(), "natural_end").when(F.col("cursor_again"), "cursor_stalled")


def expansion_outcomes(pages: DataFrame, max_pages: int = MAX_EXPANSION_PAGES) -> DataFrame:
    """pages: task_id, account_id, page_no, n_users, cursor_out -> pages and reason of each chain (null: not finished)."""
    told = _dealt(pages.select(*CHAIN, "page_no", "n_users", "cursor_out"), "account_id")
    rows = _with_history(_with_again(told, CHAIN), CHAIN, "n_users")
    return _first_end(rows, CHAIN, _page_end().when(F.col("n") >= max_pages, "page_limit"), [F.sum("n_users").alias("users")])


def timeline_outcomes(pages: DataFrame, target_posts: int = TARGET_POSTS, max_scanned: int = MAX_SCANNED, max_pages: int = MAX_TIMELINE_PAGES) -> DataFrame:
    """pages: task_id, account_id, page_no, n_posts, n_own, n_qualifying, cursor_out -> why each sample was finished."""
    upto = _upto(CHAIN)
    told = _dealt(pages.select(*CHAIN, "page_no", "n_posts", "n_own", "n_qualifying", "cursor_out"), "account_id")
    rows = _with_history(_with_again(told, CHAIN), CHAIN, "n_posts").withColumns({"scanned": F.sum("n_own").over(upto), "qualifying": F.sum("n_qualifying").over(upto)})
    enough = _page_end().when(F.col("qualifying") >= target_posts, "target_reached").when(F.col("scanned") >= max_scanned, "scan_limit")
    return _first_end(rows, CHAIN, enough.when(F.col("n") >= max_pages, "page_limit"), [F.max("scanned").alias("scanned"), F.max("qualifying").alias("qualifying")])


def pagination_outcomes(pages: DataFrame, limit: int = -1) -> DataFrame:
    """pages: chain_id, queue, page_no, entry_ids, cursor_out -> how a general pagination ended.

    Stalled: the cursor, or for searches the list of entries, is that of the page before. Empty pages with a cursor go
    on, three in a row don't. A limit is looked at after a page, which is given whole.
    """
    chain = ["chain_id"]
    before = Window.partitionBy(*chain).orderBy("page_no")
    # lists of entries are only compared, so their digests are dealt and sorted instead
    entries = F.when(F.col("queue") == "SearchTimeline", F.sha2(F.to_json("entry_ids"), 256))
    told = _dealt(pages.select(*chain, "page_no", F.size("entry_ids").alias("n_items"), entries.alias("__entries"), "cursor_out"), "chain_id")
    rows = _with_history(told, chain, "n_items")
    same_cursor = F.col("cursor_out") == F.lag("cursor_out").over(before)
    same_entries = (F.col("n_items") > 0) & (F.col("__entries") == F.lag("__entries").over(before))
    total = F.sum("n_items").over(_upto(chain))
    rows = rows.withColumns({"stalled": F.coalesce(same_cursor, F.lit(False)) | F.coalesce(same_entries, F.lit(False)), "total": total})
    reason = F.when(F.col("stalled"), "stalled").when(F.col("empty_run") >= EMPTY_LIMIT, "empty_pages").when(F.col("cursor_out").isNull(), "end")
    if limit > 0:
        reason = reason.when((F.col("n_items") > 0) & (F.col("total") >= limit), "limit")
    return _first_end(rows, chain, reason, [F.sum(F.when(~F.col("stalled"), F.col("n_items")).otherwise(0)).alias("items")])
