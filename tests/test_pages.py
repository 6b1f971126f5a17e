import json

import pytest
from pyspark.sql import functions as F

from fernweave.functions import rules
from fernweave.operators import feeds, parse, rich
from fernweave.sources import events, seeds

WHEN = "Sat Dec 14 04:35:55 +0000 2013"


def user(i, **more):
    return {"__typename": "User", "rest_id": i, "core": {"screen_name": "u" + i, "name": "", "created_at": WHEN}, "legacy": {"name": "L" + i, "followers_count": "7", "protected": True}, **more}


def tweet(i, author="1", more=None, **legacy):
    core = {"user_results": {"result": {"rest_id": author}}}
    return {"__typename": "Tweet", "rest_id": i, "core": core, "legacy": {"full_text": "t" + i, "created_at": WHEN, "user_id_str": author, **legacy}, "views": {"count": "12"}, **(more or {})}


def entry(result, **item):
    return {"content": {"entryType": "TimelineTimelineItem", "itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}, **item}}}


def pages(spark, *payloads):
    return spark.createDataFrame([(f"p{k}", p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)], "page string, payload string")


def test_users(spark):
    nulls = user("1", relationship_counts={"followers": None}, dm_permissions={"can_dm": 1})
    given = {"data": [nulls, user("2", is_blue_verified=True, location={"location": "here"}, legacy={}), user("1", legacy={}), {"__typename": "User", "rest_id": "3"}]}
    rows = parse.users(pages(spark, given, "no json", None, {}), ["page"]).orderBy("position").collect()
    one, two = rows
    assert (one["account_id"], one["display_name"], one["followers_count"], one["can_dm"], one["protected"], one["position"]) == ("1", "L1", None, None, True, 1)
    assert (two["location"], two["blue_verified"], two["followers_count"], str(two["created_at"])) == ("here", True, None, "2013-12-14 04:35:55")
    single = {r["page"]: r["error"] for r in parse.single_user(pages(spark, {"a": user("5")}, given), ["page"]).collect()}
    assert single == {"p0": None, "p1": "users on this page, not one: 2"}


def test_posts(spark):
    repost = tweet("11", retweeted_status_result={"result": {"rest_id": "5"}}, is_quote_status=True)
    hidden = {"__typename": "TweetWithVisibilityResults", "tweet": tweet("15", quoted_status_id_str="4")}
    module = {"content": {"entryType": "TimelineTimelineModule", "items": [{"item": {"itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": tweet("16")}}}}, {"item": {"itemContent": {"itemType": "TimelineUser"}}}]}}
    listed = [entry(tweet("10")), entry(repost), entry(tweet("12", is_quote_status=True)), entry(tweet("10", favorite_count=9)), entry(tweet("13", in_reply_to_status_id_str="10", in_reply_to_user_id_str="1")), entry(tweet("14"), promotedMetadata={"a": 1}), entry(hidden), module]
    given = {"i": [{"type": "TimelineAddEntries", "entries": listed}, {"type": "TimelinePinEntry", "entry": entry(tweet("17", author="9", more={"views": {}, "ext_views": {"count": 3}}))}, {"type": "Other", "entries": [entry(tweet("99"))]}]}
    got = {r["post_id"]: r for r in parse.posts(pages(spark, given), ["page"]).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"10": "original", "11": "retweet", "12": "quote", "13": "reply", "15": "quote", "16": "original", "17": "original"}
    assert got["10"]["like_count"] == 0 and got["17"]["view_count"] == 3 and got["13"]["is_self_thread_reply"] and got["11"]["retweeted_tweet_id"] == "5"
    own = parse.own_posts(parse.posts(pages(spark, given), ["page"]).withColumn("account_id", F.lit("1")))
    assert "17" not in {r["post_id"] for r in own.collect()}


def test_cursors(spark):
    given = pages(spark, {"a": {"cursorType": "Top", "value": "t"}, "b": [{"cursorType": "Bottom", "value": 5}, {"cursorType": "Bottom", "value": "b1"}, {"cursorType": "Bottom", "value": "b2"}]}, {"s": {"next_cursor": "n"}})
    assert {tuple(r) for r in parse.cursors(given, ["page"]).collect()} == {("p0", "b1")}
    assert {tuple(r) for r in parse.cursors(given, ["page"], fallback=True).collect()} == {("p0", "b1"), ("p1", "n")}


def test_full_posts(spark):
    photo = {"type": "photo", "media_url_https": "m1"}
    clip = {"type": "video", "media_url_https": "m2", "video_info": {"duration_millis": 5, "variants": [{"content_type": "a"}, {"bitrate": 8, "content_type": "b", "url": "v"}]}}
    poll = {"legacy": {"name": "poll2choice_text_only", "binding_values": [{"key": k, "value": {"type": "STRING", "string_value": s}} for k, s in (("choice1_label", "x"), ("choice1_count", "3"), ("choice2_label", "y"))] + [{"key": "counts_are_final", "value": {"type": "BOOLEAN", "boolean_value": True}}]}}
    original = tweet("5", author="2", extended_entities={"media": [photo, clip]}, entities={"hashtags": [{"text": "h"}], "urls": [{"expanded_url": "e", "url": "s", "display_url": "d"}, {"url": "only"}]}, source='<a href="https://app">App</a>')
    repost = tweet("6", retweeted_status_result={"result": {"rest_id": "5"}}, more={"views": {}})
    repost["legacy"]["full_text"] = "RT @u2: t…"
    talk = tweet("7", in_reply_to_status_id_str="5", in_reply_to_user_id_str="3", entities={"user_mentions": [{"id_str": "3", "screen_name": "m3", "name": "M"}]}, edit_control={"edit_control_initial": {"a": 1, "b": 2}, "b": 3}, card=poll, geo={"coordinates": [1.5, 2.5]})
    flat = {"__typename": "Tweet", "rest_id": "8", "legacy": None, "full_text": "flat", "created_at": WHEN, "user_id_str": "1", "reply_count": 4}
    given = {"x": [user("1"), user("2"), original, repost, talk, flat, tweet("9", author="nobody", more={"core": {}})]}
    found = rich.tweets(pages(spark, given), ["page"]).cache()
    got = {r["id_str"]: r for r in found.collect()}
    assert set(got) == {"5", "6", "7", "8"} and {k for k, r in got.items() if not r["is_item"]} == {"5"}
    assert got["6"]["rawContent"] == "RT @u2: t5" and got["6"]["viewCount"] == 12 and got["6"]["user"]["username"] == "u1"
    five = got["5"]
    assert [p["url"] for p in five["media"]["photos"]] == ["m1"] and five["media"]["videos"][0]["variants"] == [("b", 8, "v")]
    assert (five["hashtags"], [tuple(x) for x in five["links"]], five["sourceUrl"], five["sourceLabel"]) == (["h"], [("e", "d", "s")], "https://app", "App")
    seven = got["7"]
    assert seven["inReplyToUser"]["username"] == "m3" and seven["coordinates"]["longitude"] == 2.5 and set(seven["editControl"]) == {"a", "b"}
    assert seven["card"]["type"] == "poll" and [tuple(o) for o in seven["card"]["options"]] == [("x", 3)] and seven["card"]["finished"]
    assert got["8"]["rawContent"] == "flat" and got["8"]["replyCount"] == 4 and got["8"]["conversationIdStr"] == "8"
    shown = rich.items(found).withColumns({k: F.col(f"media.{k}") for k in ("photos", "videos", "animated")})
    assert feeds.with_media(shown).count() == 0 and feeds.details(shown, "7").count() == 1


def test_full_posts_of_a_page_without_a_key_and_without_a_shuffle(spark):
    repost = tweet("6", author="9", retweeted_status_id_str="5", in_reply_to_user_id_str="9")
    repost["legacy"]["full_text"] = "RT @u2: t…"
    given = {"x": [user("2"), user("9"), tweet("5", author="2", more={"core": {}}), repost]}
    rows = spark.createDataFrame([(None, json.dumps(given)), ("p", json.dumps(given))], "page string, payload string")
    found = rich.tweets(rows, ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {(r["page"], r["id_str"]): (r["rawContent"], r["is_item"], r["inReplyToUser"] and r["inReplyToUser"]["username"]) for r in found.select("page", "id_str", "rawContent", "is_item", "inReplyToUser").collect()}
    assert got == {(page, key): told for page in (None, "p") for key, told in (("5", ("t5", False, None)), ("6", ("RT @u2: t5", True, "u9")))}


def test_only_the_columns_asked_for_are_carried():
    given = {"x": [user("1"), tweet("5", entities={"hashtags": []}, lang="de")]}
    v, author, *_ = next(rich._page_posts(given, frozenset(["lang"])))
    assert json.loads(v)["legacy"] == {"lang": "de", "created_at": WHEN} and author is None
    v, author, *_ = next(rich._page_posts(given, frozenset(["hashtags", "url"])))
    assert "entities" in json.loads(v)["legacy"] and json.loads(author)["rest_id"] == "1"


def test_cards(spark):
    value = lambda k, s: {"key": k, "value": {"type": "STRING", "string_value": s}}
    image = lambda h, u: {"key": "i" + u, "value": {"type": "IMAGE", "image_value": {"height": h, "url": u}}}
    kinds = {
        "1": ("summary", [value("title", "short"), value("x_alt_text", "longer title"), value("description", "d"), value("card_url", "c"), image(1, "a"), image(9, "b"), {"key": "k", "value": {"type": "IMAGE_COLOR"}}]),
        "2": ("745291183405076480:broadcast", [value("broadcast_url", "b")]),
        "3": ("3691233323:audiospace", [value("card_url", "space")]),
        "4": ("2586390716:message_me", [value("card_url", "m"), value("cta", "go"), {"key": "recipient", "value": {"type": "USER", "user_value": {"id_str": "77"}}}]),
        "5": ("unknown", []),
        "6": ("unified_card", [value("unified_card", json.dumps({"component_objects": {"details_1": {"data": {"title": {"content": "T"}}}}, "media_entities": {"z": {"type": "photo", "media_url_https": "pic"}}}))]),
    }
    given = {"x": [user("1"), *[tweet(i, card={"legacy": {"name": n, "binding_values": v}}) for i, (n, v) in kinds.items()]]}
    got = {r["id_str"]: r["card"] for r in rich.tweets(pages(spark, given), ["page"]).select("id_str", "card").collect()}
    assert (got["1"]["title"], got["1"]["photoUrl"], got["1"]["vanityUrl"]) == ("longer title", "b", "")
    assert got["2"] is None and got["5"] is None and got["3"]["url"] == "space"
    assert (got["4"]["cta"], got["4"]["recipientId"]) == ("go", "77") and (got["6"]["title"], got["6"]["photoUrl"]) == ("T", "pic")


def test_full_users_trends_communities_about(spark):
    nested = user("1", relationship_counts={"followers": 5}, verification={"verified_type": "Business"}, pinned_items={"tweet_ids_str": ["9"]}, avatar={"image_url": "i"}, profile_bio={"description": "bio", "entities": {"url": {"urls": [{"expanded_url": "e", "url": "s"}]}}})
    bare = {"__typename": "User", "rest_id": "2", "legacy": {"screen_name": "two", "name": "Two"}}
    got = {r["id_str"]: r["user"] for r in rich.users(pages(spark, {"x": [nested, bare, {"__typename": "User", "rest_id": "3"}]}), ["page"]).collect()}
    assert set(got) == {"1", "2"} and (got["1"]["followersCount"], got["1"]["blueType"], got["1"]["pinnedIds"], got["1"]["rawDescription"], got["1"]["profileImageUrl"]) == (5, "Business", [9], "bio", "i")
    assert got["1"]["descriptionLinks"][0]["url"] == "e" and str(got["2"]["created"]) == "1970-01-01 00:00:00" and got["2"]["url"] == "https://x.com/two"
    url = {"url": "u", "urlType": "t", "urtEndpointOptions": {"requestParams": [{"key": "k", "value": "v"}]}}
    trend = {"__typename": "TimelineTrend", "name": "n", "rank": "3", "trend_url": url, "trend_metadata": {"url": url}, "grouped_trends": [{"name": "g", "url": url}]}
    row = rich.trends(pages(spark, {"t": [trend]}), ["page"]).head()
    assert (row["id"], row["rank"], row["grouped_trends"][0]["name"], row["trend_url"]["urlEndpointOptions"][0]["key"]) == ("trend-n", 3, "g", "k")
    club = {"data": {"communityResults": {"result": {"rest_id": "4", "name": "c", "member_count": 2, "rules": [{"rest_id": "r", "name": "be kind"}], "primary_community_topic": {"topic_id": "x"}}}}}
    row = rich.communities(pages(spark, club, {}, "bad"), ["page"]).collect()
    assert len(row) == 1 and (row[0]["id"], row[0]["rules"][0]["name"], row[0]["topicId"]) == (4, "be kind", "x")
    told = {"data": {"user_result_by_screen_name": {"result": {"rest_id": "8", "core": {"screen_name": "s"}, "about_profile": {"username_changes": {"count": "1"}}}}}}
    row = rich.about(pages(spark, told, None), ["page"]).collect()
    assert len(row) == 1 and (row[0]["rest_id"], row[0]["username_changes"], row[0]["screen_name"]) == (8, 1, "s")


def test_seed_lists(spark):
    raw = " @Abc, https://x.com/abc?x=1\nbad handle!\r\n\n@@q\nzed\n@ spaced"
    row = seeds.seed_import(spark.createDataFrame([(1, raw), (2, " \n,"), (3, None)], "id int, raw string")).collect()
    assert len(row) == 1 and (row[0]["handles"], row[0]["duplicates"], row[0]["invalid"], row[0]["total_lines"]) == (["Abc", "zed", "spaced"], ["abc"], ["bad handle!", "@@q"], 6)


def test_events_round_trip(spark):
    made = spark.createDataFrame([("e1", 1, "t", "tr", "a1", "Following", 2, None, "c", 200, None, None, None, '{"a":[1,null]}')], events.EVENT)
    sent = events.encoded(made)
    assert sent.head()["key"] == "a1"
    back = events.decoded(sent.select("value").unionByName(spark.createDataFrame([("xx",), ('{"event_id":"1"}',), (None,)], "value string"))).collect()
    good = [r for r in back if r["problem"] is None]
    assert len(good) == 1 and json.loads(good[0]["payload"]) == {"a": [1, None]} and good[0]["depth"] == 2 and len(back) == 4


@pytest.mark.parametrize(
    ("status", "headers", "body", "codes", "messages", "expected"),
    [
        (200, {"content-type": "text/html"}, False, [], [], "blocked"),
        (429, {}, False, [], [], "rate_limited"),
        (200, {"x-rate-limit-remaining": "0", "x-rate-limit-reset": "1760000000"}, True, [], [], "rate_limited"),
        (200, {"x-rate-limit-remaining": "0"}, True, [], [], None),
        (200, {}, True, [336], [], "features_outdated"),
        (200, {"x-rate-limit-remaining": "3"}, True, [88], [], "account_unavailable"),
        (200, {}, True, [88], [], None),
        (200, {}, True, [-1], ["Loadshed"], "platform_overloaded"),
        (403, {}, True, [], [], "authentication"),
        (403, {}, True, [1], ["x"], "invalid_response"),
        (200, {}, False, [], [], "invalid_response"),
        (200, {}, True, [], [], None),
    ],
)
def test_response_classes(spark, status, headers, body, codes, messages, expected):
    df = spark.createDataFrame([(status, headers, body, codes, messages)], "s int, h map<string,string>, b boolean, c array<int>, m array<string>")
    assert df.select(rules.response_class(F.col("s"), F.col("h"), F.col("b"), F.col("c"), F.col("m"))).head()[0] == expected


def test_content_entries_and_limits(spark):
    df = spark.createDataFrame([(["tweet-1", "cursor-top", "who-to-follow-3", "module-x"],)], "ids array<string>").select(F.transform("ids", lambda i: F.struct(i.alias("entryId"))).alias("e"))
    assert [x["entryId"] for x in df.select(rules.content_entries(F.col("e"))).head()[0]] == ["tweet-1"]
    rows = spark.createDataFrame([("c", p, k) for p in (1, 2, 3) for k in range(4)], "c string, page_no int, k int")
    assert feeds.as_of_limit(rows, ["c"], 5).count() == 8
