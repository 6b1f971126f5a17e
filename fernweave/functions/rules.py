"""Rules as column expressions: chain endings, post kinds, response classes, page identity, validation of states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Why a chain of pages stopped, by who ended it.
PLATFORM_ENDED = ("natural_end", "empty_pages", "cursor_stalled")
SELF_ENDED = ("page_limit", "budget_exhausted")
# The states of tasks, and where each may go.
TASK_MOVES = {
    "created": {"running", "terminated"},
    "validating": {"running", "failed", "terminated"},
    "running": {"paused", "completed", "failed", "terminated"},
    "paused": {"running", "terminated"},
    "completed": set(),
    "failed": {"running", "terminated"},
    "terminated": set(),
}
QUALIFYING = ("original", "quote")
# Entries of a timeline that aren't content, by how their ids begin.
NOT_CONTENT = ("cursor-", "messageprompt-", "module-", "who-to-follow-")
RATE_LIMIT_FALLBACK_S = 900
# The names under which failures of a chain are counted, by what was raised.
ERROR_CLASSES = {
    "AccountUnavailableError": "account_unavailable",
    "AuthenticationError": "authentication",
    "BlockedError": "blocked",
    "FeaturesOutdatedError": "features_outdated",
    "PlatformOverloadedError": "platform_overloaded",
    "RateLimitedError": "rate_limited",
    "TransportError": "transport",
}


def post_kind(retweeted_id: Column, reply_to_id: Column, quoted_id: Column, is_quote: Column) -> Column:
    """One kind for each post: a repost before a reply before a quote before an original."""
    quote = quoted_id.isNotNull() | F.coalesce(is_quote, F.lit(False))
    return F.when(retweeted_id.isNotNull(), "retweet").when(reply_to_id.isNotNull(), "reply").when(quote, "quote").otherwise("original")


def is_qualifying(kind: Column) -> Column:
    return kind.isin(*QUALIFYING)


def is_self_thread_reply(kind: Column, reply_to_user: Column, author: Column) -> Column:
    return F.coalesce((kind == "reply") & (reply_to_user == author), F.lit(False))


def page_identity(operation: Column, account_id: Column, cursor: Column) -> Column:
    """The same page asked for again has the same id, whatever it contains."""
    nul = F.lit("\x00")
    return F.sha2(F.concat(operation, nul, account_id, nul, F.coalesce(cursor, F.lit(""))), 256)


def header_int(headers: Column, name: str) -> Column:
    return F.try_to_number(F.regexp_extract(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0)), r"^\s*([+-]?\d+)\s*$", 1), F.lit("S999999999999999999")).cast("bigint")


def rate_limit(headers: Column) -> Column:
    """limit, remaining and reset_at from the three headers; each null where its header is missing or no number."""
    reset = header_int(headers, "x-rate-limit-reset")
    return F.struct(header_int(headers, "x-rate-limit-limit").alias("limit"), header_int(headers, "x-rate-limit-remaining").alias("remaining"), F.timestamp_seconds(reset).alias("reset_at"))


def response_class(status: Column, headers: Column, has_body: Column, codes: Column, messages: Column) -> Column:
    """What a response says, or null if nothing is wrong with it. The first rule that fits decides.

    codes and messages: of the errors in the body, as arrays; has_body: whether the body could be read as JSON.
    """
    content_type = F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type")), F.lit(0)), F.lit(""))
    remaining, reset = header_int(headers, "x-rate-limit-remaining"), header_int(headers, "x-rate-limit-reset")
    named = reset > 0
    said = lambda words: F.exists(messages, lambda m: F.lower(m).contains(words))
    code = lambda n: F.array_contains(codes, F.lit(n))
    rules = [
        (content_type.contains("text/html"), "blocked"),
        ((status == 429) | ((remaining == 0) & named), "rate_limited"),
        (~has_body, "invalid_response"),
        (code(336) | said("features cannot be null"), "features_outdated"),
        (code(88) & (remaining > 0), "account_unavailable"),
        (code(326), "account_unavailable"),
        (code(32), "authentication"),
        (code(-1) & said("loadshed"), "platform_overloaded"),
        ((status == 403) & (F.size(codes) == 0), "authentication"),
        (status >= 400, "invalid_response"),
    ]
    first = lambda acc, rule: acc.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[1]))
    return reduce(first, rules, F).otherwise(F.lit(None).cast("string"))


def held_back_until(response: Column, headers: Column, received_at: Column) -> Column:
    """When a rate-limited account may ask again: when the header says, else a whole window later."""
    reset = header_int(headers, "x-rate-limit-reset")
    until = F.when(reset > 0, F.timestamp_seconds(reset)).otherwise(F.timestamp_micros(F.unix_micros(received_at) + RATE_LIMIT_FALLBACK_S * 1_000_000))
    return F.when(response == "rate_limited", until)


def error_class(raised: Column) -> Column:
    """The name under which a failure is counted; one that has no name of its own counts by what was raised."""
    named = F.map_from_arrays(F.array(*map(F.lit, ERROR_CLASSES)), F.array(*map(F.lit, ERROR_CLASSES.values())))
    return F.coalesce(F.element_at(named, raised), raised)


def content_entries(entries: Column) -> Column:
    """Timeline entries (structs with entryId) without cursors, prompts, modules and suggestions."""
    return F.filter(entries, lambda e: ~e["entryId"].rlike("^(" + "|".join(NOT_CONTENT) + ")"))


def may_move(current: Column, target: Column) -> Column:
    """Whether a task may go from one state to another; staying is no move and always allowed."""
    allowed = F.map_from_arrays(F.array(*map(F.lit, TASK_MOVES)), F.array(*[F.array(*map(F.lit, sorted(to))).cast("array<string>") for to in TASK_MOVES.values()]))
    return F.coalesce((current == target) | F.array_contains(F.element_at(allowed, current), target), F.lit(False))


def source_url(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, "href=['\"]?([^'\" >]+)", 1), F.lit(""))


def source_label(source: Column) -> Column:
    """The text between the tags: empty where they hold none, null where there are no tags."""
    return F.when(source.rlike(">[^<]*<"), F.regexp_extract(source, ">([^<]*)<", 1))
