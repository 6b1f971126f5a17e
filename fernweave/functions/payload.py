"""Captured pages as rows: one walk over each payload, then nothing but expressions over VARIANT.

A payload nests to any depth, which no expression can follow. So each page is walked once, in Arrow batches, and the
objects of interest come out as rows in the order of the walk (an object before what it holds). What they say is then
read with variant paths in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Timeline instructions whose entries are the timeline's own, and where each keeps them.
INSTRUCTIONS = {"TimelineAddEntries": "entries", "TimelinePinEntry": "entry"}
#: Bytes of payload whose objects are held at a time.
SLICE = 4_000_000


def _objects(value: Any) -> Iterator[dict[str, Any]]:
    """Every object, an object before what it holds. A list of its own instead of recursion: payloads may nest deeply."""
    open_ = [value]
    while open_:
        now = open_.pop()
        if type(now) is dict:
            yield now
            open_ += [x for x in reversed(now.values()) if type(x) is dict or type(x) is list]
        elif type(now) is list:
            open_ += [x for x in reversed(now) if type(x) is dict or type(x) is list]


def found(payload: Any, types: frozenset[str]) -> Iterator[tuple[str, Any]]:
    """(kind, object): objects of the wanted types by their type's name, entries of timelines, and cursors."""
    entries, cursors = "entry" in types, "cursor" in types
    for obj in _objects(payload):
        name = obj.get("__typename")
        if isinstance(name, str) and name in types:
            yield name, obj
        place = INSTRUCTIONS.get(obj.get("type")) if entries and isinstance(obj.get("type"), str) else None
        if place:
            held = obj.get(place)
            for entry in held if isinstance(held, list) else [held]:
                if isinstance(entry, dict):
                    yield "entry", entry
        if cursors:
            if isinstance(obj.get("cursorType"), str):
                yield "cursor", {"type": obj["cursorType"], "value": obj.get("value")}
            if isinstance(obj.get("next_cursor"), str):
                yield "cursor", {"type": "next_cursor", "value": obj["next_cursor"]}


def told_by(pages: DataFrame, fields: str, rows: Callable[[Any], Iterable[tuple]], payload: str = "payload") -> DataFrame:
    """pages without the payload, once for each row (of the schema `fields`) that rows() tells of the parsed payload.

    A payload that is null or no JSON counts as null.
    """
    own = StructType.fromDDL(fields)
    kept = pages.select(*[c for c in pages.columns if c != payload and c not in own.names], F.col(payload).cast("string").alias("__payload"))
    schema = StructType([*kept.drop("__payload").schema, *own])
    types = to_arrow_schema(own).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__payload")
            held, size = [], 0
            for i, text in enumerate(batch.column(at)):
                raw = text.as_py()
                try:
                    loaded = json.loads(raw) if raw else None
                except ValueError:
                    loaded = None
                held += [(i, *row) for row in rows(loaded)]
                size += len(raw or "")
                if size > SLICE:
                    yield told(batch, at, held)
                    held, size = [], 0
            if held:
                yield told(batch, at, held)

    def told(batch: pa.RecordBatch, at: int, held: list[tuple]) -> pa.RecordBatch:
        place, *values = zip(*held, strict=True) if held else [()] * (len(types) + 1)
        rest = [c.take(pa.array(place, pa.int64())) for k, c in enumerate(batch.columns) if k != at]
        return pa.RecordBatch.from_arrays([*rest, *[pa.array(v, t) for v, t in zip(values, types, strict=True)]], schema.names)

    return kept.mapInArrow(run, schema)


def walked(pages: DataFrame, types: list[str], payload: str = "payload") -> DataFrame:
    """pages without the payload, once for each object: ord, kind, obj (VARIANT).

    types: type names, and "entry" (of timelines) or "cursor". A payload that is null or no JSON gives no rows.
    """
    wanted = frozenset(types)

    def rows(loaded: Any) -> Iterator[tuple[int, str, str]]:
        for k, (kind, obj) in enumerate(found(loaded, wanted)):
            yield k, kind, json.dumps(obj)

    return told_by(pages, "ord bigint, kind string, obj string", rows, payload).withColumn("obj", F.parse_json("obj"))


# Reading variants


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def present(v: Column, path: str) -> Column:
    """Whether the key is there, with null as its value or not."""
    return at(v, path, "variant").isNotNull()


def text(v: Column, path: str) -> Column:
    """A string; an empty one counts as missing."""
    return F.nullif(at(v, path), F.lit(""))


def integer(v: Column, path: str) -> Column:
    """An integer, given as a number or as digits; a fraction is cut off a number, and makes a string none."""
    kind = F.schema_of_variant(at(v, path, "variant"))
    digits = F.when(at(v, path).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(at(v, path)).try_cast("bigint"))
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", at(v, path, "boolean").cast("bigint")).otherwise(F.coalesce(at(v, path, "bigint"), at(v, path, "double").try_cast("bigint")))


def whole(value: Column) -> Column:
    """A VARIANT itself as an integer, by the same rules."""
    kind, told = F.schema_of_variant(value), lambda name: F.try_variant_get(value, "$", name)
    digits = F.when(told("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(told("string")).try_cast("bigint"))
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", told("boolean").cast("bigint")).otherwise(F.coalesce(told("bigint"), told("double").try_cast("bigint")))


def boolean(v: Column, path: str) -> Column:
    """Only true and false themselves: a 1 or a "true" is neither."""
    return F.when(F.schema_of_variant(at(v, path, "variant")) == "BOOLEAN", at(v, path, "boolean"))


def moment(value: Column) -> Column:
    """A date like "Sat Dec 14 04:35:55 +0000 2013". The day's name isn't read: it follows from the rest."""
    return F.try_to_timestamp(F.substring(value, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))


def key_or(v: Column, first: str, second: str, read) -> Column:
    """read at first if that key is there, even as null; else read at second."""
    return F.when(present(v, first), read(v, first)).otherwise(read(v, second))


# Pages of the graph


def user_profile(v: Column) -> Column:
    """A user object, of either layout, as a profile; null without an id or a name."""
    place = F.when(F.schema_of_variant(at(v, "location", "variant")).startswith("OBJECT"), at(v, "location.location")).otherwise(F.coalesce(text(v, "location"), at(v, "legacy.location")))
    account_id = F.coalesce(text(v, "rest_id"), at(v, "legacy.id_str"))
    username = F.coalesce(text(v, "core.screen_name"), text(v, "legacy.screen_name"))
    profile = F.struct(
        account_id.alias("account_id"),
        username.alias("username"),
        F.coalesce(text(v, "core.name"), text(v, "legacy.name"), F.lit("")).alias("display_name"),
        F.coalesce(text(v, "profile_bio.description"), text(v, "legacy.description"), F.lit("")).alias("description"),
        key_or(v, "relationship_counts.followers", "legacy.followers_count", integer).cast("int").alias("followers_count"),
        key_or(v, "relationship_counts.following", "legacy.friends_count", integer).cast("int").alias("following_count"),
        moment(F.coalesce(text(v, "core.created_at"), text(v, "legacy.created_at"))).alias("created_at"),
        key_or(v, "privacy.protected", "legacy.protected", boolean).alias("protected"),
        key_or(v, "verification.verified", "legacy.verified", boolean).alias("verified"),
        boolean(v, "is_blue_verified").alias("blue_verified"),
        boolean(v, "dm_permissions.can_dm").alias("can_dm"),
        place.alias("location"),
        F.coalesce(text(v, "avatar.image_url"), at(v, "legacy.profile_image_url_https")).alias("avatar_url"),
        F.coalesce(text(v, "banner.image_url"), at(v, "legacy.profile_banner_url")).alias("banner_url"),
    )
    return F.when(account_id.isNotNull() & username.isNotNull(), profile)
