"""Queries over captured pages, made of the driver's tables: full posts, users, cards, media, trends, communities, about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.common import cut
from fernweave.operators import feeds, rich
from fernweave.plans.queries import SPAN, query
from fernweave.sources.adapters import frame

KEYS = ["page", "part"]
ORIGINAL, MENTIONED = 1_000_000_000, "880000777"


def _page(rows: DataFrame, page: Column, number: Column, obj: Column) -> DataFrame:
    """Pages (page, part) with the objects of their rows in order; a part spans SPAN numbers, so none grows with the table."""
    objects = F.transform(F.sort_array(F.collect_list(F.struct(number.alias("n"), F.to_json(obj).alias("o")))), lambda x: x["o"])
    payload = F.concat(F.lit('{"data":{"entries":['), F.array_join(objects, ","), F.lit("]}}"))
    return rows.groupBy(page.cast("string").alias("page"), F.floor(number / SPAN).alias("part")).agg(payload.alias("payload"))


def _text(number: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _bound(key: str, value: Column, kind: str = "STRING") -> Column:
    """A value of a card, with the field of its kind."""
    told = {"STRING": value.cast("string"), "IMAGE": F.struct(F.lit(40).alias("height"), value.alias("url")), "BOOLEAN": F.lit(True), "USER": F.struct(value.alias("id_str"))}
    names = {"STRING": "string_value", "IMAGE": "image_value", "BOOLEAN": "boolean_value", "USER": "user_value"}
    return F.struct(F.lit(key).alias("key"), F.struct(F.lit(kind).alias("type"), *[F.when(F.lit(kind == k), v).alias(names[k]) for k, v in told.items()]).alias("value"))


UNIFIED_JSON = '{"component_objects":{"details_1":{"data":{"title":{"content":"head"},"subtitle":{"content":"below"}}}},"destination_objects":{"browser_with_docked_media_1":{"data":{"url_data":{"url":"https://u.example","vanity":"u.example"}}}},"media_entities":{"5":{"type":"photo","media_url_https":"https://p.example/5"}}}'


def _card(k: Column) -> Column:
    n = k.cast("string")
    kinds = {
        0: ("summary", [_bound("title", _text(k, "title ")), _bound("description", F.lit("what it is")), _bound("vanity_url", F.lit("v.example")), _bound("card_url", _text(k, "https://t.example/")), _bound("thumb", F.lit("https://i.example/1"), "IMAGE")]),
        1: ("poll2choice_text_only", [_bound("choice1_label", F.lit("yes")), _bound("choice1_count", n), _bound("choice2_label", F.lit("no")), _bound("choice2_count", F.lit("4")), _bound("counts_are_final", n, "BOOLEAN")]),
        2: (rich.BROADCAST, [_bound("broadcast_url", F.lit("https://b.example")), _bound("broadcast_title", _text(k, "live "))]),
        3: (rich.AUDIOSPACE, [_bound("card_url", _text(k, "https://a.example/"))]),
        4: (rich.MESSAGE_ME, [_bound("card_url", F.lit("https://m.example")), _bound("cta", F.lit("write")), _bound("recipient", n, "USER")]),
        5: (rich.UNIFIED, [_bound("unified_card", F.lit(UNIFIED_JSON))]),
        6: ("of_no_kind", [_bound("title", F.lit("x"))]),
    }
    out = F
    for rest, (name, values) in kinds.items():
        out = out.when(k % 8 == rest, F.struct(F.struct(F.lit(name).alias("name"), F.array(*values).alias("binding_values")).alias("legacy")))
    return out.otherwise(F.lit(None))


def _media(k: Column) -> Column:
    photo = F.struct(F.lit("photo").alias("type"), _text(k, "https://p.example/").alias("media_url_https"))
    variants = lambda *rates: F.array(*[F.struct(F.lit("video/mp4").alias("content_type"), F.lit(r).cast("int").alias("bitrate"), F.lit(f"https://v.example/{r}").alias("url")) for r in rates])
    moving = lambda kind, *rates: F.struct(F.lit(kind).alias("type"), _text(k, "https://t.example/").alias("media_url_https"), F.struct(variants(*rates).alias("variants"), (k % 900).alias("duration_millis")).alias("video_info"), F.struct((k * 2).alias("viewCount")).alias("mediaStats"))
    as_json = lambda *found: F.array(*[F.to_json(x) for x in found])
    return F.when(k % 4 == 1, as_json(photo, photo)).when(k % 4 == 2, as_json(moving("video", 800, None, 2400), photo)).when(k % 4 == 3, as_json(moving("animated_gif", 0)))


def _user(key: Column, name: Column) -> Column:
    return F.struct(F.lit("User").alias("__typename"), key.cast("string").alias("rest_id"), F.struct(name.alias("screen_name"), F.concat(F.lit("Name "), name).alias("name")).alias("core"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of posts, one for each order: reposts with their originals inside, replies, media, cards, places, limited visibility."""
    o = frame(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    when = lambda n, v: F.when(k % n == 0, v)
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE MMM dd HH:mm:ss '+0000' yyyy")
    entities = F.struct(
        F.array(F.struct(_text(k % 9, "tag").alias("text")), F.struct(F.lit("all").alias("text"))).alias("hashtags"),
        F.array(F.struct(_text(k, "https://l.example/").alias("expanded_url"), F.lit("https://t.co/x").alias("url")), F.struct(F.lit("https://short.example").alias("expanded_url"), F.lit(None).cast("string").alias("url"))).alias("urls"),
        F.array(F.struct(F.lit(MENTIONED).alias("id_str"), F.lit("m777").alias("screen_name"), F.lit("Mention").alias("name"))).alias("user_mentions"),
    )
    original = F.struct(
        F.lit("Tweet").alias("__typename"),
        (k + ORIGINAL).cast("string").alias("rest_id"),
        F.struct(F.struct(_user(F.lit(900_000_000), F.lit("origin")).alias("result")).alias("user_results")).alias("core"),
        F.struct(F.lit("77").alias("count")).alias("views"),
        F.struct(_text(k, "said first: ").alias("full_text"), date.alias("created_at"), F.lit("900000000").alias("user_id_str")).alias("legacy"),
    )
    legacy = F.struct(
        F.when(k % 7 == 0, F.lit("RT @origin: sai…")).otherwise(_text(k, "text ")).alias("full_text"),
        date.alias("created_at"),
        c.cast("string").alias("user_id_str"),
        (k - k % 4).cast("string").alias("conversation_id_str"),
        (k % 50).alias("favorite_count"),
        (k % 6).alias("retweet_count"),
        F.element_at(F.array(*map(F.lit, ("en", "de"))), (k % 2 + 1).cast("int")).alias("lang"),
        when(5, (k - k % 4).cast("string")).alias("in_reply_to_status_id_str"),
        when(5, F.when(k % 10 == 0, F.lit(MENTIONED)).otherwise(c.cast("string"))).alias("in_reply_to_user_id_str"),
        entities.alias("entities"),
        F.struct(F.transform(_media(k), lambda x: F.parse_json(x)).alias("media")).alias("extended_entities"),
        when(9, F.struct(F.lit("pl").alias("id"), F.lit("Far, Away").alias("full_name"))).alias("place"),
        when(11, F.struct(F.array((k % 90).cast("double"), F.lit(12.5)).alias("coordinates"))).alias("coordinates"),
        when(13, F.lit(True)).alias("possibly_sensitive"),
        when(7, F.struct(original.alias("result"))).alias("retweeted_status_result"),
    )
    tweet = F.struct(
        F.lit("Tweet").alias("__typename"),
        k.cast("string").alias("rest_id"),
        F.struct(F.struct(_user(c, _text(c, "user")).alias("result")).alias("user_results")).alias("core"),
        F.when(k % 4 != 0, F.struct((k * 3).cast("string").alias("count"))).alias("views"),
        F.concat(F.lit('<a href="https://s.example/x" rel="nofollow">App '), (k % 3).cast("string"), F.lit("</a>")).alias("source"),
        _card(k).alias("card"),
        legacy.alias("legacy"),
    )
    limited = F.struct(F.lit("TweetWithVisibilityResults").alias("__typename"), F.when(k % 6 == 0, tweet).alias("tweet"))
    obj = F.struct(F.when(k % 6 == 0, limited).alias("limited"), F.when(k % 6 != 0, tweet).alias("free"))
    return _page(o, c % 20, k, obj)


_DATE = "strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
PARSED = f"""
    SELECT o_orderkey AS k, CAST(o_custkey % 20 AS STRING) AS page, CAST(o_orderkey AS STRING) AS id_str, concat('user', CAST(o_custkey AS STRING)) AS username, {_DATE} AS date,
           CASE WHEN o_orderkey % 7 = 0 THEN concat('RT @origin: said first: ', CAST(o_orderkey AS STRING)) ELSE concat('text ', CAST(o_orderkey AS STRING)) END AS content, true AS is_item FROM {{orders}}
    UNION ALL
    SELECT o_orderkey, CAST(o_custkey % 20 AS STRING), CAST(o_orderkey + {ORIGINAL} AS STRING), 'origin', {_DATE}, concat('said first: ', CAST(o_orderkey AS STRING)), false FROM {{orders}} WHERE o_orderkey % 7 = 0"""


@query(
    """SELECT page, id_str, concat('https://x.com/', username, '/status/', id_str) AS url, username, date, content, is_item,
              CASE WHEN is_item THEN CAST(k % 50 AS INT) ELSE 0 END AS likes, CAST(CASE WHEN NOT is_item THEN 77 WHEN k % 4 <> 0 THEN k * 3 WHEN k % 7 = 0 THEN 77 END AS BIGINT) AS views,
              CASE WHEN is_item THEN CAST(k - k % 4 AS STRING) ELSE id_str END AS conversation, CASE WHEN is_item THEN concat('tag', CAST(k % 9 AS STRING), '|all') ELSE '' END AS hashtags,
              CASE WHEN is_item THEN concat('https://l.example/', CAST(k AS STRING)) ELSE '' END AS links, CASE WHEN is_item THEN 'm777' ELSE '' END AS mentions,
              CASE WHEN is_item AND k % 7 = 0 THEN CAST(k + 1000000000 AS STRING) END AS retweeted, CASE WHEN is_item AND k % 5 = 0 THEN CAST(k - k % 4 AS STRING) END AS reply_to,
              CASE WHEN is_item AND k % 10 = 0 THEN 'm777' WHEN is_item AND k % 5 = 0 THEN username END AS reply_user, CASE WHEN is_item THEN concat('App ', CAST(k % 3 AS STRING)) END AS source_label,
              CASE WHEN is_item THEN 'https://s.example/x' END AS source_url, CASE WHEN is_item AND k % 9 = 0 THEN 'Far, Away' END AS place, CASE WHEN is_item AND k % 11 = 0 THEN CAST(k % 90 AS DOUBLE) END AS longitude,
              CASE WHEN is_item AND k % 13 = 0 THEN true END AS sensitive, CASE WHEN NOT is_item THEN '' WHEN k % 2 = 0 THEN 'en' ELSE 'de' END AS lang
       FROM {parsed}""",
    parsed=PARSED,
)
def rich_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id_str", "url", "user", "date", "rawContent", "likeCount", "viewCount", "conversationIdStr", "hashtags", "links", "mentionedUsers", "retweetedId", "inReplyToTweetIdStr", "inReplyToUser", "sourceLabel", "sourceUrl", "place", "coordinates", "possibly_sensitive", "lang"]
    p = rich.tweets(posts(spark, sf_dir), KEYS, columns)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return p.select(
        "page", "id_str", "url", F.col("user.username").alias("username"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("rawContent").alias("content"), "is_item",
        F.col("likeCount").cast("int").alias("likes"), F.col("viewCount").cast("bigint").alias("views"), F.col("conversationIdStr").alias("conversation"), F.array_join("hashtags", "|").alias("hashtags"),
        joined("links", "url").alias("links"), joined("mentionedUsers", "username").alias("mentions"), F.col("retweetedId").alias("retweeted"), F.col("inReplyToTweetIdStr").alias("reply_to"),
        F.col("inReplyToUser.username").alias("reply_user"), F.col("sourceLabel").alias("source_label"), F.col("sourceUrl").alias("source_url"), F.col("place.fullName").alias("place"),
        F.col("coordinates.longitude").alias("longitude"), F.col("possibly_sensitive").alias("sensitive"), "lang",
    )


@query(
    """SELECT id_str, CASE k % 8 WHEN 1 THEN 'poll' WHEN 2 THEN 'broadcast' WHEN 3 THEN 'audiospace' WHEN 4 THEN 'message_me' ELSE 'summary' END AS type,
              CASE k % 8 WHEN 0 THEN concat('title ', id_str) WHEN 2 THEN concat('live ', id_str) WHEN 5 THEN 'head' END AS title, CASE k % 8 WHEN 0 THEN 'what it is' WHEN 5 THEN 'below' END AS description,
              CASE k % 8 WHEN 0 THEN concat('https://t.example/', id_str) WHEN 2 THEN 'https://b.example' WHEN 3 THEN concat('https://a.example/', id_str) WHEN 4 THEN 'https://m.example' WHEN 5 THEN 'https://u.example' END AS url,
              CASE k % 8 WHEN 0 THEN 'https://i.example/1' WHEN 5 THEN 'https://p.example/5' END AS photo, CASE WHEN k % 8 = 4 THEN id_str END AS recipient,
              CASE WHEN k % 8 = 1 THEN concat('yes=', id_str, '|no=4') END AS options, CASE WHEN k % 8 = 1 THEN true END AS finished
       FROM {parsed} WHERE is_item AND k % 8 < 6""",
    parsed=PARSED,
)
def rich_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: a filter pushed below the card would read it twice
    p = cut(rich.items(rich.tweets(posts(spark, sf_dir), KEYS, ["id_str", "card"])).select("id_str", "card")).filter("card IS NOT NULL")
    options = F.array_join(F.transform("card.options", lambda x: F.concat(x["label"], F.lit("="), x["votesCount"].cast("string"))), "|")
    return p.select("id_str", "card.type", "card.title", "card.description", "card.url", F.col("card.photoUrl").alias("photo"), F.col("card.recipientId").alias("recipient"), options.alias("options"), "card.finished")


@query(
    """SELECT id_str, CAST(CASE k % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INT) AS photos, CASE WHEN k % 4 = 2 THEN '800|2400' ELSE '' END AS bitrates, CASE WHEN k % 4 = 2 THEN CAST(k % 900 AS BIGINT) END AS duration,
              CASE WHEN k % 4 = 2 THEN CAST(k * 2 AS BIGINT) END AS video_views, CASE WHEN k % 4 = 3 THEN 'https://v.example/0' END AS animation
       FROM {parsed} WHERE is_item AND k % 4 <> 0""",
    parsed=PARSED,
)
def rich_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feeds.with_media(cut(rich.items(rich.tweets(posts(spark, sf_dir), KEYS, ["id_str", "media"])).select("id_str", "media.*")))
    rates = F.array_join(F.transform(F.flatten(F.transform("videos", lambda x: x["variants"])), lambda x: x["bitrate"].cast("string")), "|")
    one = lambda c: F.get(F.col(c), F.lit(0))
    return p.select("id_str", F.size("photos").alias("photos"), rates.alias("bitrates"), one("videos")["duration"].alias("duration"), one("videos")["views"].cast("bigint").alias("video_views"), one("animated")["videoUrl"].alias("animation"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rich.items(rich.tweets(posts(spark, sf_dir), KEYS, ["id_str", "conversationIdStr", "inReplyToTweetIdStr"]))
    return p.select("id_str", F.col("conversationIdStr").alias("conversation_id"), F.col("inReplyToTweetIdStr").alias("in_reply_to_id"))


@query("SELECT CAST(o_orderkey AS STRING) AS id_str FROM {orders} WHERE o_orderkey - o_orderkey % 4 = 4")
def parsed_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.thread(_talk(spark, sf_dir), "4").select("id_str")


@query("SELECT CAST(o_orderkey AS STRING) AS id_str FROM {orders} WHERE o_orderkey - o_orderkey % 4 = 4 AND o_orderkey % 5 = 0")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.replies(_talk(spark, sf_dir), "4").select("id_str")


@query(
    """SELECT CAST(c_nationkey AS STRING) AS page, CAST(c_custkey AS STRING) AS id_str, c_name AS username, concat('Name ', c_name) AS displayname, CASE WHEN c_custkey % 2 = 0 THEN concat('about ', c_mktsegment) ELSE '' END AS about,
              CAST(c_custkey % 700 AS INT) AS followers, CAST(c_custkey % 70 AS INT) AS friends, CASE WHEN c_custkey % 2 = 0 THEN 'Town' ELSE 'Village' END AS location, c_custkey % 3 = 0 AS protected, c_custkey % 5 = 0 AS verified,
              CASE WHEN c_custkey % 2 = 0 THEN 'https://home.example' ELSE '' END AS links, CASE WHEN c_custkey % 2 = 0 THEN '2013-12-14 04:35:55' ELSE '1970-01-01 00:00:00' END AS created
       FROM {customer}"""
)
def rich_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    home = F.array(F.struct(F.lit("https://home.example").alias("expanded_url"), F.lit("https://t.co/h").alias("url")))
    nested = F.struct(
        F.lit("User").alias("__typename"), k.cast("string").alias("rest_id"),
        F.struct(name.alias("screen_name"), F.concat(F.lit("Name "), name).alias("name"), F.lit("Sat Dec 14 04:35:55 +0000 2013").alias("created_at")).alias("core"),
        F.struct((k % 700).alias("followers"), (k % 70).alias("following")).alias("relationship_counts"), F.struct(F.lit("Town").alias("location")).alias("location"),
        F.struct((k % 3 == 0).alias("protected")).alias("privacy"), F.struct((k % 5 == 0).alias("verified")).alias("verification"),
        F.struct(F.concat(F.lit("about "), F.col("c_mktsegment")).alias("description"), F.struct(F.struct(home.alias("urls")).alias("url")).alias("entities")).alias("profile_bio"),
    )
    legacy = F.struct(k.cast("string").alias("id_str"), name.alias("screen_name"), F.concat(F.lit("Name "), name).alias("name"), (k % 700).alias("followers_count"), (k % 70).cast("string").alias("friends_count"), F.lit("Village").alias("location"), (k % 3 == 0).alias("protected"), (k % 5 == 0).alias("verified"))
    flat = F.struct(F.lit("User").alias("__typename"), legacy.alias("legacy"))
    pages = _page(c, F.col("c_nationkey"), k, F.struct(F.when(k % 2 == 0, nested).alias("a"), F.when(k % 2 == 1, flat).alias("b")))
    u = rich.users(pages, KEYS).select("page", "user.*")
    return u.select("page", "id_str", "username", "displayname", F.col("rawDescription").alias("about"), F.col("followersCount").cast("int").alias("followers"), F.col("friendsCount").cast("int").alias("friends"), "location", "protected", "verified", F.array_join(F.transform("descriptionLinks", lambda x: x["url"]), "|").alias("links"), F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(
    """SELECT CAST(p_size AS STRING) AS page, concat('trend-', p_name, ' ', CAST(p_partkey AS STRING)) AS id, CAST(p_partkey % 30 AS INT) AS rank, concat('https://trend.example/', CAST(p_partkey AS STRING)) AS url, p_brand AS context,
              concat('cd=', CAST(p_partkey AS STRING)) AS params, concat('beside ', CAST(p_partkey AS STRING)) AS grouped FROM {part}"""
)
def rich_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "part")
    k = F.col("p_partkey")
    url = F.struct(_text(k, "https://trend.example/").alias("url"), F.lit("DeepLink").alias("urlType"), F.struct(F.array(F.struct(F.lit("cd").alias("key"), k.cast("string").alias("value"))).alias("requestParams")).alias("urtEndpointOptions"))
    obj = F.struct(F.lit("TimelineTrend").alias("__typename"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), (k % 30).cast("string").alias("rank"), url.alias("trend_url"), F.struct(F.col("p_brand").alias("domain_context")).alias("trend_metadata"), F.array(F.struct(_text(k, "beside ").alias("name"))).alias("grouped_trends"))
    t = rich.trends(_page(p, F.col("p_size"), k, obj), KEYS)
    params = F.array_join(F.transform("trend_url.urlEndpointOptions", lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    return t.select("page", "id", F.col("rank").cast("int").alias("rank"), "trend_url.url", F.col("trend_metadata.domain_context").alias("context"), params.alias("params"), F.array_join(F.transform("grouped_trends", lambda x: x["name"]), "|").alias("grouped"))


def _wrapped(rows: DataFrame, key: Column, path: str, obj: Column) -> DataFrame:
    return rows.select(key.alias("page"), F.concat(F.lit('{"data":{"' + path + '":{"result":'), F.to_json(obj), F.lit("}}}")).alias("payload"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_custkey % 90 AS BIGINT) AS members, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 ELSE 0 END AS BIGINT) AS moderators, concat('be ', c_mktsegment, '|') AS rules, c_mktsegment AS topic, CASE WHEN c_custkey % 4 = 0 THEN true END AS nsfw FROM {customer}")
def rich_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frame(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rules = F.array(F.struct(F.lit("1").alias("rest_id"), F.concat(F.lit("be "), F.col("c_mktsegment")).alias("name")), F.struct(F.lit("2").alias("rest_id"), F.lit(None).cast("string").alias("name")))
    obj = F.struct(k.cast("string").alias("rest_id"), F.col("c_name").alias("name"), (k % 90).alias("member_count"), F.when(k % 2 == 0, k % 5).alias("moderator_count"), rules.alias("rules"), F.struct(F.col("c_mktsegment").alias("topic_name")).alias("primary_community_topic"), F.when(k % 4 == 0, F.lit(True)).alias("is_nsfw"))
    found = rich.communities(_wrapped(c, k, "communityResults", obj), ["page"])
    return found.select("id", "name", F.col("memberCount").alias("members"), F.col("moderatorCount").alias("moderators"), F.array_join(F.transform("rules", lambda x: x["name"]), "|").alias("rules"), F.col("topicName").alias("topic"), F.col("isNsfw").alias("nsfw"))


@query("SELECT concat('user', CAST(s_suppkey AS STRING)) AS screen_name, s_name AS name, CAST(s_suppkey AS BIGINT) AS rest_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS STRING) END AS based_in, s_suppkey % 3 = 0 AS accurate, CAST(s_suppkey % 4 AS BIGINT) AS changes, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1700000000000 + s_suppkey END AS BIGINT) AS verified_since FROM {supplier}")
def rich_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    profile = F.struct(F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).alias("account_based_in"), (k % 3 == 0).alias("location_accurate"), F.struct((k % 4).cast("string").alias("count")).alias("username_changes"))
    verified = F.when(k % 5 == 0, F.struct(F.struct((F.lit(1_700_000_000_000) + k).cast("string").alias("verified_since_msec")).alias("reason")))
    obj = F.struct(k.cast("string").alias("rest_id"), F.struct(_text(k, "user").alias("screen_name"), F.col("s_name").alias("name")).alias("core"), profile.alias("about_profile"), verified.alias("verification_info"))
    found = rich.about(_wrapped(s, k, "user_result_by_screen_name", obj), ["page"])
    return found.select("screen_name", "name", F.col("rest_id").cast("bigint").alias("rest_id"), F.col("account_based_in").alias("based_in"), F.col("location_accurate").alias("accurate"), F.col("username_changes").cast("bigint").alias("changes"), F.col("verified_since_msec").cast("bigint").alias("verified_since"))
