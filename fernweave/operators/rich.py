"""Full records of posts, users, trends, communities and profiles of captured pages, as nested columns.

Objects come in two layouts, all fields at the top or most under `legacy`; a key at the top counts, even as null, and
only what isn't there is looked up below. Posts refer to posts and users of the same page by id: a page is one row, where
authors and originals are looked up, so a post is one flat row however deeply the page nested it; `retweetedId` and `quotedId` lead to the rows
of the posts that it holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.payload import at, boolean, found, integer, moment, present, text, told_by, walked
from fernweave.functions.rules import source_label, source_url

SITE = "https://x.com"
# Names of cards, by what they are.
SUMMARY, UNIFIED = ("summary", "summary_large_image", "player"), "unified_card"
POLL = r"^(?:\d+:)?poll(?:\d+choice_text_only|_choice_images)"
BROADCAST, AUDIOSPACE, MESSAGE_ME = "745291183405076480:broadcast", "3691233323:audiospace", "2586390716:message_me"
POLL_OPTIONS = 20
_LAST = "ord"
_POSTS = frozenset(["Tweet", "TweetWithVisibilityResults", "User"])
_OF_ORIGINALS = ("created_at", "full_text", "note_tweet", "ext_views", "views")
# Fields of a post that its columns are read from; those of _ALWAYS are carried for all of them.
_ALWAYS = ("rest_id", "id_str", "created_at")
_FIELDS = {
    "lang": ["lang"], "rawContent": ["note_tweet", "full_text"], "replyCount": ["reply_count"], "retweetCount": ["retweet_count"], "likeCount": ["favorite_count"], "quoteCount": ["quote_count"],
    "bookmarkedCount": ["bookmark_count"], "conversationId": ["conversation_id_str"], "conversationIdStr": ["conversation_id_str"], "hashtags": ["entities"], "cashtags": ["entities"], "mentionedUsers": ["entities"],
    "links": ["entities", "note_tweet"], "media": ["extended_entities"], "viewCount": ["ext_views", "views"], "retweetedId": ["retweeted_status_id_str", "retweeted_status_result"],
    "quotedId": ["quoted_status_id_str", "quoted_status_result"], "place": ["place"], "coordinates": ["coordinates", "geo"], "inReplyToTweetId": ["in_reply_to_status_id_str"], "inReplyToTweetIdStr": ["in_reply_to_status_id_str"],
    "inReplyToUser": ["in_reply_to_user_id_str", "entities"], "source": ["source"], "sourceUrl": ["source"], "sourceLabel": ["source"], "card": ["card"], "possibly_sensitive": ["possibly_sensitive"],
    "isQuoteStatus": ["is_quote_status"], "isTranslatable": ["is_translatable"], "displayTextRange": ["display_text_range"], "inReplyToScreenName": ["in_reply_to_screen_name"], "editControl": ["edit_control"], "voiceInfo": ["voice_info"],
    "id": [], "id_str": [], "url": [], "date": [], "user": [],
}


def field(v: Column, name: str, read=at) -> Column:
    """A field of either layout."""
    return F.when(present(v, name), read(v, name)).otherwise(read(v, f"legacy.{name}"))


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _list(v: Column, path: str) -> Column:
    """A list of variants; empty where there is none."""
    return F.coalesce(at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _either_list(v: Column, path: str) -> Column:
    return F.coalesce(at(v, path, "array<variant>"), at(v, f"legacy.{path}", "array<variant>"), F.array().cast("array<variant>"))


def links(urls: Column) -> Column:
    """Links that have both an address and a short one, both strings."""
    whole = F.filter(urls, lambda u: (F.schema_of_variant(at(u, "expanded_url", "variant")) == "STRING") & (F.schema_of_variant(at(u, "url", "variant")) == "STRING"))
    return F.transform(whole, lambda u: F.struct(at(u, "expanded_url").alias("url"), at(u, "display_url").alias("text"), at(u, "url").alias("tcourl")))


def _last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several objects with one id the last one in the walk, told before rows are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), _LAST).alias("__last")).select(*keys, "__last.*")


def _named(v: Column, name: str) -> Column:
    return F.coalesce(at(v, name), at(v, f"legacy.{name}"), at(v, f"core.{name}"))


def user_record(v: Column) -> Column:
    """A user, of either layout, with every field; a missing date of creation is the epoch."""
    name = lambda n: _named(v, n)
    count = lambda n, *paths: _or(F.coalesce(*[integer(v, p) for p in paths], field(v, n, integer)), 0)
    id_str = F.coalesce(text(v, "rest_id"), text(v, "id_str"), text(v, "legacy.id_str"))
    entities = F.when(F.schema_of_variant(at(v, "profile_bio.entities", "variant")).startswith("OBJECT"), "profile_bio.entities")
    urls = lambda part: F.when(entities.isNotNull(), _list(v, f"profile_bio.entities.{part}.urls")).otherwise(_either_list(v, f"entities.{part}.urls"))
    place = F.when(F.schema_of_variant(at(v, "location", "variant")).startswith("OBJECT"), at(v, "location.location")).otherwise(F.coalesce(text(v, "location"), at(v, "legacy.location")))
    flag = lambda n, path: F.when(present(v, n) | present(v, f"legacy.{n}"), field(v, n, boolean)).otherwise(boolean(v, path))
    return F.struct(
        id_str.try_cast("bigint").alias("id"),
        id_str.alias("id_str"),
        F.concat(F.lit(f"{SITE}/"), name("screen_name")).alias("url"),
        name("screen_name").alias("username"),
        name("name").alias("displayname"),
        _or(F.coalesce(F.nullif(field(v, "description"), F.lit("")), at(v, "profile_bio.description")), "").alias("rawDescription"),
        F.coalesce(moment(name("created_at")), F.timestamp_seconds(F.lit(0))).alias("created"),
        count("followers_count", "relationship_counts.followers").alias("followersCount"),
        count("friends_count", "relationship_counts.following").alias("friendsCount"),
        count("statuses_count", "tweet_counts.tweets").alias("statusesCount"),
        count("favourites_count", "action_counts.favorites_count").alias("favouritesCount"),
        count("listed_count").alias("listedCount"),
        count("media_count", "tweet_counts.media_tweets").alias("mediaCount"),
        _or(place, "").alias("location"),
        _or(F.coalesce(F.nullif(field(v, "profile_image_url_https"), F.lit("")), text(v, "avatar.image_url")), "").alias("profileImageUrl"),
        F.coalesce(at(v, "banner.image_url"), field(v, "profile_banner_url")).alias("profileBannerUrl"),
        flag("protected", "privacy.protected").alias("protected"),
        flag("verified", "verification.verified").alias("verified"),
        field(v, "is_blue_verified", boolean).alias("blue"),
        F.coalesce(field(v, "verified_type"), at(v, "verification.verified_type")).alias("blueType"),
        F.concat(links(urls("description")), links(urls("url"))).alias("descriptionLinks"),
        F.transform(F.coalesce(at(v, "pinned_items.tweet_ids_str", "array<string>"), at(v, "pinned_tweet_ids_str", "array<string>"), at(v, "legacy.pinned_tweet_ids_str", "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("bigint")).alias("pinnedIds"),
    )


def users(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, user): the users of a page, of several mentions the last; those without a name are left out."""
    return _users(walked(pages.select(*keys, "payload"), ["User"]), keys)


def _users(objects: DataFrame, keys: list[str]) -> DataFrame:
    rows = _last_users(objects, keys)
    return rows.select(*keys, "id_str", user_record(F.col("obj")).alias("user"))


def _last_users(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id_str, obj): users as they are on a page, which are read into records where they are asked for."""
    user = user_record(F.col("obj"))
    rows = objects.filter("kind = 'User'").select(*keys, "ord", "obj", user["id_str"].alias("id_str"), user["username"].alias("__name"))
    rows = rows.filter((F.col("__name") != "") & F.col("id_str").isNotNull()).drop("__name")
    return _last_of(rows, [*keys, "id_str"]).select(*keys, "id_str", "obj")


def _paths(kind: str) -> list[str]:
    """Where a post tells the id of another, the first place first."""
    return [f"{kind}_status_id_str", f"{kind}_status_result.result.rest_id", f"{kind}_status_result.result.tweet.rest_id"]


def _referenced(v: Column, kind: str) -> Column:
    return F.coalesce(*[F.coalesce(at(v, p), at(v, f"legacy.{p}")) for p in _paths(kind)])


def _views(v: Column) -> Column:
    return F.coalesce(integer(v, "ext_views.count"), integer(v, "views.count"))


def media(v: Column) -> Column:
    """photos, videos (with the variants that have a bit rate) and animations."""
    found = _either_list(v, "extended_entities.media")
    of = lambda kind: F.filter(found, lambda m: at(m, "type") == kind)
    return F.struct(
        F.transform(of("photo"), lambda m: F.struct(at(m, "media_url_https").alias("url"))).alias("photos"),
        F.transform(of("video"), video).alias("videos"),
        F.transform(F.filter(of("animated_gif"), lambda m: at(m, "video_info.variants[0].url").isNotNull()), lambda m: F.struct(at(m, "media_url_https").alias("thumbnailUrl"), at(m, "video_info.variants[0].url").alias("videoUrl"))).alias("animated"),
    )


def video(m: Column) -> Column:
    variants = F.filter(_list(m, "video_info.variants"), lambda x: present(x, "bitrate"))
    told = F.transform(variants, lambda x: F.struct(at(x, "content_type").alias("contentType"), at(x, "bitrate", "bigint").alias("bitrate"), at(x, "url").alias("url")))
    return F.struct(at(m, "media_url_https").alias("thumbnailUrl"), told.alias("variants"), at(m, "video_info.duration_millis", "bigint").alias("duration"), integer(m, "mediaStats.viewCount").alias("views"))


def card(v: Column) -> Column:
    """A card as one struct whose type says which of its fields count; null for no card or one of an unknown kind."""
    name = F.coalesce(at(v, "card.legacy.name"), at(v, "legacy.card.legacy.name"))
    told = F.transform(_either_list(v, "card.legacy.binding_values"), lambda x: F.struct(at(x, "key").alias("key"), at(x, "value.type").alias("type"), at(x, "value.string_value").alias("text"), x.alias("v")))
    given = F.struct(name.alias("name"), F.filter(told, lambda x: x["type"] != "IMAGE_COLOR").alias("values"))
    return F.when(name.isNotNull(), _let(given, lambda g: _card(g["name"], g["values"])))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _first(values: Column, key: Column | str) -> Column:
    """The first value of a key, of values (key, type, text, v)."""
    return F.get(F.filter(values, lambda x: x["key"] == key), F.lit(0))


def _card(name: Column, values: Column) -> Column:
    first = lambda key: _first(values, key)["text"]
    texts = F.transform(F.filter(values, lambda x: (x["key"] == "title") | x["key"].endswith("_alt_text")), lambda x: x["text"])
    longest = F.aggregate(texts, F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a))
    images = F.transform(F.filter(values, lambda x: x["type"] == "IMAGE"), lambda x: F.struct(at(x["v"], "value.image_value.height", "int").alias("h"), at(x["v"], "value.image_value.url").alias("u")))
    tallest = F.aggregate(images, F.lit(None).cast("struct<h:int,u:string>"), lambda a, b: F.when(a.isNull() | (b["h"] > a["h"]), b).otherwise(a))["u"]
    unified = F.try_parse_json(first("unified_card"))
    entity = F.get(F.map_values(at(unified, "media_entities", "map<string,variant>")), F.lit(0))
    options = F.transform(F.sequence(F.lit(1), F.lit(POLL_OPTIONS)), lambda i: F.struct(first(F.concat(F.lit("choice"), i.cast("string"), F.lit("_label"))).alias("label"), first(F.concat(F.lit("choice"), i.cast("string"), F.lit("_count"))).try_cast("bigint").alias("votesCount")))
    gap = lambda found: F.array_position(F.transform(found, lambda o: o["label"].isNull() | o["votesCount"].isNull()), F.lit(True))
    kept = _let(options, lambda found: F.slice(found, F.lit(1), F.when(gap(found) > 0, (gap(found) - 1).cast("int")).otherwise(F.lit(POLL_OPTIONS))))
    final = _or(at(_first(values, "counts_are_final")["v"], "value.boolean_value", "boolean"), False)
    recipient = at(F.get(F.filter(values, lambda x: (x["key"] == "recipient") & (x["type"] == "USER")), F.lit(0))["v"], "value.user_value.id_str")

    def shaped(kind: str, **given: Column) -> Column:
        kinds = {c: "string" for c in ("title", "description", "vanityUrl", "url", "photoUrl", "cta", "recipientId")} | {"options": "array<struct<label:string,votesCount:bigint>>", "finished": "boolean", "videoUrl": "string"}
        return F.struct(F.lit(kind).alias("type"), *[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    has = lambda *keys: reduce(lambda x, y: x & y, [first(k).isNotNull() for k in keys])
    details = lambda part: _or(at(unified, f"component_objects.details_1.data.{part}.content"), "")
    docked = lambda part: _or(at(unified, f"destination_objects.browser_with_docked_media_1.data.url_data.{part}"), "")
    of_kind = lambda kind: F.when(at(entity, "type") == kind, at(entity, "media_url_https"))
    return (
        F.when(name.isin(*SUMMARY), shaped("summary", title=longest, description=_or(first("description"), ""), vanityUrl=_or(first("vanity_url"), ""), url=_or(first("card_url"), ""), photoUrl=tallest))
        .when((name == UNIFIED) & unified.isNotNull(), shaped("summary", title=details("title"), description=details("subtitle"), vanityUrl=docked("vanity"), url=docked("url"), photoUrl=of_kind("photo"), videoUrl=of_kind("video")))
        .when(name.rlike(POLL), shaped("poll", options=kept, finished=final))
        .when((name == BROADCAST) & has("broadcast_url", "broadcast_title"), shaped("broadcast", title=first("broadcast_title"), url=first("broadcast_url"), photoUrl=tallest))
        .when((name == AUDIOSPACE) & has("card_url"), shaped("audiospace", url=first("card_url")))
        .when((name == MESSAGE_ME) & has("card_url"), shaped("message_me", url=first("card_url"), cta=first("cta"), recipientId=recipient))
    )


def _edit_control(v: Column) -> Column:
    """The entries of edit_control, those of its first version below them; as a map."""
    own = F.coalesce(at(v, "edit_control", "map<string,variant>"), at(v, "legacy.edit_control", "map<string,variant>"))
    rest = F.map_filter(own, lambda k, _: k != "edit_control_initial")
    first = F.coalesce(at(v, "edit_control.edit_control_initial", "map<string,variant>"), at(v, "legacy.edit_control.edit_control_initial", "map<string,variant>"))
    below = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(rest), k))
    return F.when(first.isNotNull(), F.map_concat(below, rest)).otherwise(own)


# Posts of a page, which refer to posts and users of the same page by id


def _inside(obj: Any, *path: str) -> Any:
    for name in path:
        obj = obj.get(name) if isinstance(obj, dict) else None
    return obj


def _key(*values: Any) -> str | None:
    """The first value that there is, as the text by which objects are looked up."""
    value = next((x for x in values if x is not None), None)
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _of_either(v: dict[str, Any], name: str) -> str | None:
    return _key(v[name] if name in v else _inside(v, "legacy", name))


def _only(obj: dict[str, Any], names: tuple[str, ...]) -> dict[str, Any]:
    """obj with some of its fields, of either layout."""
    parts = {part: {n: obj[part][n] for n in names if n in obj[part]} for part in ("legacy", "core") if isinstance(obj.get(part), dict)}
    return parts | {n: obj[n] for n in names if n in obj}


def _name(user: Any) -> str | None:
    return _key(*[_inside(user, *part, "screen_name") for part in ((), ("legacy",), ("core",))])


def _page_posts(payload: Any, columns: frozenset[str]) -> Iterator[tuple[str, str | None, str | None, str | None, str | None, list[str]]]:
    """The posts of one page whose author is known: v, author, replier, original, its author, reposts, as JSON.

    An author is the user of the page who has the id, else the one inside the post. Only what the columns are read from.
    """
    names = (*_ALWAYS, *sorted({name for c in columns for name in _FIELDS[c]}))
    users: dict[str, dict] = {}
    posts: dict[str, tuple[bool, dict]] = {}
    for kind, obj in found(payload, _POSTS):
        if kind == "User":
            key = _key(*[None if x == "" else x for x in (obj.get("rest_id"), obj.get("id_str"), _inside(obj, "legacy", "id_str"))])
            if key is not None and _name(obj):
                users[key] = obj
            continue
        limited = kind == "TweetWithVisibilityResults"
        v = obj.get("tweet") if limited else obj
        if isinstance(v, dict) and "legacy" in v:
            key = _key(None if v.get("rest_id") == "" else v.get("rest_id"), _of_either(v, "id_str"))
            if key is not None and (limited or key not in posts or not posts[key][0]):
                posts[key] = limited, v
    authors: dict[str, Any] = {}
    for key, (_, v) in posts.items():
        user = users.get(_of_either(v, "user_id_str"))
        for holder in (_inside(v, "core", "user_results"), v.get("author_results")):
            if user is None and isinstance(holder, dict) and "result" in holder and _key(_inside(holder, "result", "__typename")) != "UserUnavailable":
                user = holder["result"] or {}
        if _name(user) is not None:
            authors[key] = user
    originals = {key: _key(*[_inside(posts[key][1], *at, *path.split(".")) for path in _paths("retweeted") for at in ((), ("legacy",))]) for key in authors}
    by: dict[str, list[str]] = {}
    for key, original in originals.items():
        if original in authors:
            by.setdefault(original, []).append(json.dumps(_only(posts[key][1], ("created_at",))))

    @cache
    def told(key: str | None) -> tuple[str | None, str | None]:
        return (json.dumps(_only(posts[key][1], _OF_ORIGINALS)), json.dumps(_only(authors[key], ("screen_name",)))) if key in authors else (None, None)

    @cache
    def replier(key: str | None) -> str | None:
        return json.dumps(users[key]) if key in users else None

    with_author, with_replier, with_original = (not columns.isdisjoint(of) for of in (("user", "url"), ("inReplyToUser",), ("rawContent", "viewCount")))
    for key, author in authors.items():
        v = posts[key][1]
        answered = _of_either(v, "in_reply_to_user_id_str") if with_replier else None
        yield json.dumps(_only(v, names)), json.dumps(author) if with_author else None, replier(answered), *told(originals[key] if with_original else None), by.get(key, [])


def _content(v: Column) -> Column:
    note = F.coalesce(at(v, "note_tweet.note_tweet_results.result.text"), at(v, "legacy.note_tweet.note_tweet_results.result.text"))
    return _or(F.coalesce(note, field(v, "full_text")), "")


def _date(v: Column) -> Column:
    return moment(field(v, "created_at"))


def tweets(pages: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The posts of a page, which is a row of pages: keys, every column (or those of columns), and is_item (not just the original of a repost on the same page).

    Of several mentions the last counts, and one with limited visibility before one without. Posts whose author is
    nowhere on the page are left out. A repost's text that was cut off is made whole from its original.

    Pages are walked once, and a post comes out with the users and posts of its page that it refers to: nothing is
    shuffled. It has the fields with it that its columns are read from, so a column that isn't among `columns` costs nothing.
    """
    asked = frozenset(_FIELDS if columns is None else columns)
    texts = ["v", "author", "replier", "original", "writer"]
    told = told_by(pages.select(*keys, "payload"), ", ".join(f"{c} string" for c in texts) + ", reposts array<string>", lambda payload: _page_posts(payload, asked))
    # by inline each text is parsed once, however many fields are read of it
    rows = told.select(*keys, "reposts", F.inline(F.array(F.struct(*[F.parse_json(c).alias(f"__{c}") for c in texts]))))
    v, original = F.col("__v"), F.col("__original")
    rows = rows.filter(_date(v).isNotNull()).withColumn("id_str", F.coalesce(text(v, "rest_id"), field(v, "id_str")))
    rows = rows.withColumns({"retweetedId": _referenced(v, "retweeted"), "quotedId": _referenced(v, "quoted"), "reply_user": field(v, "in_reply_to_user_id_str")})
    mentions = F.transform(_either_list(v, "entities.user_mentions"), lambda m: F.struct(at(m, "id_str").try_cast("bigint").alias("id"), at(m, "id_str").alias("id_str"), at(m, "screen_name").alias("username"), at(m, "name").alias("displayname")))
    short = lambda u: F.struct(u["id"].alias("id"), u["id_str"].alias("id_str"), u["username"].alias("username"), u["displayname"].alias("displayname"))
    rows = rows.withColumns({"user": user_record(F.col("__author")), "__reply": F.when(F.col("__replier").isNotNull(), short(user_record(F.col("__replier")))), "mentionedUsers": mentions})
    mentioned = F.get(F.filter("mentionedUsers", lambda m: m["id_str"] == F.col("reply_user")), F.lit(0))
    texts = lambda path: F.transform(_either_list(v, path), lambda x: at(x, "text"))
    conversation = F.coalesce(field(v, "conversation_id_str"), F.col("id_str"))
    number = lambda name: _or(field(v, name, integer), 0)
    of_place = lambda p: F.coalesce(at(v, f"place.{p}"), at(v, f"legacy.place.{p}"))
    place = F.when(of_place("id").isNotNull(), F.struct(of_place("id").alias("id"), of_place("full_name").alias("fullName"), of_place("name").alias("name"), of_place("place_type").alias("type"), of_place("country").alias("country"), of_place("country_code").alias("countryCode")))
    point = lambda p, i: F.coalesce(at(v, f"{p}.coordinates[{i}]", "double"), at(v, f"legacy.{p}.coordinates[{i}]", "double"))
    spot = F.when(point("coordinates", 0).isNotNull(), F.struct(point("coordinates", 0).alias("longitude"), point("coordinates", 1).alias("latitude"))).when(point("geo", 0).isNotNull(), F.struct(point("geo", 1).alias("longitude"), point("geo", 0).alias("latitude")))
    source = field(v, "source")
    reply_id = field(v, "in_reply_to_status_id_str")
    whole = _date(original).isNotNull()
    content = F.when(whole & _content(v).endswith("…"), F.concat(F.lit("RT @"), _named(F.col("__writer"), "screen_name"), F.lit(": "), _content(original))).otherwise(_content(v))
    is_item = ~F.exists("reposts", lambda r: _date(F.parse_json(r)).isNotNull())
    every = rows.select(
        *keys,
        F.col("id_str").try_cast("bigint").alias("id"),
        "id_str",
        F.concat(F.lit(f"{SITE}/"), "user.username", F.lit("/status/"), "id_str").alias("url"),
        _date(v).alias("date"),
        "user",
        _or(field(v, "lang"), "").alias("lang"),
        content.alias("rawContent"),
        number("reply_count").alias("replyCount"),
        number("retweet_count").alias("retweetCount"),
        number("favorite_count").alias("likeCount"),
        number("quote_count").alias("quoteCount"),
        number("bookmark_count").alias("bookmarkedCount"),
        conversation.try_cast("bigint").alias("conversationId"),
        conversation.alias("conversationIdStr"),
        texts("entities.hashtags").alias("hashtags"),
        texts("entities.symbols").alias("cashtags"),
        "mentionedUsers",
        F.concat(links(_either_list(v, "entities.urls")), links(_either_list(v, "note_tweet.note_tweet_results.result.entity_set.urls"))).alias("links"),
        media(v).alias("media"),
        F.coalesce(_views(v), F.when(whole, _views(original))).alias("viewCount"),
        "retweetedId",
        "quotedId",
        place.alias("place"),
        spot.alias("coordinates"),
        reply_id.try_cast("bigint").alias("inReplyToTweetId"),
        reply_id.alias("inReplyToTweetIdStr"),
        F.when(F.col("reply_user").isNotNull(), F.coalesce("__reply", mentioned)).alias("inReplyToUser"),
        source.alias("source"),
        source_url(source).alias("sourceUrl"),
        source_label(source).alias("sourceLabel"),
        card(v).alias("card"),
        field(v, "possibly_sensitive", boolean).alias("possibly_sensitive"),
        _or(field(v, "is_quote_status", boolean), False).alias("isQuoteStatus"),
        _or(field(v, "is_translatable", boolean), False).alias("isTranslatable"),
        F.coalesce(at(v, "display_text_range", "array<int>"), at(v, "legacy.display_text_range", "array<int>")).alias("displayTextRange"),
        field(v, "in_reply_to_screen_name").alias("inReplyToScreenName"),
        _edit_control(v).alias("editControl"),
        F.coalesce(at(v, "voice_info", "variant"), at(v, "legacy.voice_info", "variant")).alias("voiceInfo"),
        is_item.alias("is_item"),
    )
    return every if columns is None else every.select(*keys, *columns, "is_item")


def items(found: DataFrame) -> DataFrame:
    """Posts that a page is about: without the originals of its reposts."""
    return found.filter("is_item").drop("is_item")


def _trend_url(v: Column, path: str) -> Column:
    params = F.transform(_list(v, f"{path}.urtEndpointOptions.requestParams"), lambda p: F.struct(at(p, "key").alias("key"), at(p, "value").alias("value")))
    return F.struct(at(v, f"{path}.url").alias("url"), at(v, f"{path}.urlType").alias("urlType"), params.alias("urlEndpointOptions"))


def trends(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The trends of a page, of several with one name the last."""
    rows = walked(pages.select(*keys, "payload"), ["TimelineTrend"]).withColumn("name", at(F.col("obj"), "name")).filter(F.col("name").isNotNull())
    v = F.col("obj")
    grouped = F.transform(_list(v, "grouped_trends"), lambda g: F.struct(at(g, "name").alias("name"), _trend_url(g, "url").alias("url")))
    about = F.struct(at(v, "trend_metadata.domain_context").alias("domain_context"), at(v, "trend_metadata.meta_description").alias("meta_description"), _trend_url(v, "trend_metadata.url").alias("url"))
    last = _last_of(rows, [*keys, "name"])
    return last.select(*keys, F.concat(F.lit("trend-"), "name").alias("id"), "name", integer(v, "rank").alias("rank"), _trend_url(v, "trend_url").alias("trend_url"), about.alias("trend_metadata"), grouped.alias("grouped_trends"))


def communities(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The community that a page is about, with its rules."""
    v = F.col("v")
    rows = pages.select(*keys, at(F.try_parse_json("payload"), "data.communityResults.result", "variant").alias("v")).filter(v.isNotNull())
    id_str = F.coalesce(text(v, "rest_id"), text(v, "id_str"), F.lit(""))
    rules = F.transform(_list(v, "rules"), lambda r: F.struct(F.coalesce(at(r, "rest_id"), at(r, "id_str"), F.lit("")).alias("id_str"), _or(at(r, "name"), "").alias("name"), _or(at(r, "description"), "").alias("description")))
    topic = "primary_community_topic"
    return rows.select(
        *keys,
        id_str.try_cast("bigint").alias("id"),
        id_str.alias("id_str"),
        _or(at(v, "name"), "").alias("name"),
        at(v, "description").alias("description"),
        _or(at(v, "member_count", "bigint"), 0).alias("memberCount"),
        _or(at(v, "moderator_count", "bigint"), 0).alias("moderatorCount"),
        rules.alias("rules"),
        at(v, f"{topic}.topic_id").alias("topicId"),
        at(v, f"{topic}.topic_name").alias("topicName"),
        at(v, "is_nsfw", "boolean").alias("isNsfw"),
    ).filter(F.col("id").isNotNull())


def about(pages: DataFrame, keys: list[str]) -> DataFrame:
    """What a page tells about an account: where it is based, how its name changed, since when it is verified."""
    v = F.col("v")
    rows = pages.select(*keys, at(F.try_parse_json("payload"), "data.user_result_by_screen_name.result", "variant").alias("v")).filter(v.isNotNull())
    return rows.select(
        *keys,
        _or(at(v, "core.screen_name"), "").alias("screen_name"),
        _or(at(v, "core.name"), "").alias("name"),
        integer(v, "rest_id").alias("rest_id"),
        at(v, "about_profile.account_based_in").alias("account_based_in"),
        at(v, "about_profile.location_accurate", "boolean").alias("location_accurate"),
        at(v, "about_profile.affiliate_username").alias("affiliate_username"),
        at(v, "about_profile.source").alias("source"),
        integer(v, "about_profile.username_changes.count").alias("username_changes"),
        integer(v, "about_profile.username_changes.last_changed_at_msec").alias("username_last_changed_at"),
        at(v, "verification_info.is_identity_verified", "boolean").alias("is_identity_verified"),
        integer(v, "verification_info.reason.verified_since_msec").alias("verified_since_msec"),
    )
