"""Quality rules, exact dedup, URL filters, token counts, chat: edge cases and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fernweave.llm import chat, common, crf, exact, mixing, quality, simhash, tokens, urls
from fernweave.llm import urls as urls_module

SPACE = "[\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, source string, lang string, n_words long, kept boolean"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "s", "en", 9, True) for i, t in rows], DOCS)


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def measures(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a b c a b c"), (6, "x\n x\nx\n\nx"), (6, "x\n x\nx\n\nx"), (None, "é # $ <|>"), (7, "one two three " * 30), (8, "\u00a0 \u2003 a"), (9, "a b c " * 4000)]


def test_measures_of_odd_texts(spark):
    rows = quality.judged(docs(spark, *ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        m = measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and (not r["kept"] or not r["base_failed"])


def test_order_of_the_cascade_changes_no_verdict(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["ab", "cd#", "EF", "7", "ghi"]) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    frame = docs(spark, *texts)
    t = quality.text_or_empty(F.col("text"))
    one = frame.filter(quality.first_rejection(quality.Facts(t), quality.RULES).isNull()).select("doc_id")
    two = frame.filter(quality.first_rejection(quality.Facts(t), quality.RULES[::-1]).isNull()).select("doc_id")
    kept = {r[0] for r in quality.quality_filter(frame).select("doc_id").collect()}
    assert {r[0] for r in one.collect()} == {r[0] for r in two.collect()} == kept
    assert sorted(rule.name for rule, _, _ in quality.estimate(frame, quality.RULES)) == sorted(rule.name for rule in quality.RULES)
    assert quality.cascade(frame).filter("rejected_by is null").count() == len(kept)


def test_order_of_the_cascade_by_gain():
    rules = [quality.Rule(n, lambda x: x) for n in "abc"]
    verdicts = [((True, True, False), 60), ((False, True, True), 10), ((False, False, True), 5), ((False, False, False), 25)]
    told = quality.ordered_by_gain(rules, [1.0, 1.0, 0.5], verdicts)
    # b rejects most; of the rows that it leaves a rejects none, and c rejects 5 of 30
    assert [(r.name, round(share, 3)) for r, _, share in told] == [("b", 0.7), ("c", 0.167), ("a", 0.0)]


def test_sample_is_the_same_each_time(spark):
    frame = docs(spark, *[(i, f"t {i}") for i in range(3000)]).repartition(3).cache()
    draw = lambda: sorted(r[0] for r in frame.select("doc_id").sample(fraction=500 / 3000, seed=quality.SEED).collect())
    assert draw() == draw() and 400 < len(draw()) < 600


def test_quality_of_no_rows(spark):
    none = docs(spark, (1, "x")).limit(0)
    assert quality.judged(none).count() == 0 and quality.quality_filter(none).columns == none.columns
    assert quality.quality_filter(docs(spark, (1, "x")), rules=[]).count() == 1


def groups_of(rows):
    by = defaultdict(list)
    for i, t in rows:
        by["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    return by


@pytest.mark.parametrize("most_bits", [exact.MOST_BITS, 1])
def test_exact_groups(spark, most_bits):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 70 + "a"), (8, "x" * 70 + "b"), (9, "X" * 70 + "a"), (10, "lone")]
    got = {r["doc_id"]: r for r in exact.exact_groups(docs(spark, *rows), digest=True, most_bits=most_bits).collect()}
    for text, ids in groups_of(rows).items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_exact_dedup_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a"), (2, "A"), (2, "a"), (2, "a"), (None, "a"), (None, None), (None, ""), (3, "b")]
    frame = docs(spark, *rows)
    kept = exact.exact_dedup(frame)
    assert kept.columns == frame.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({2: 1, None: 1, 3: 1})
    assert exact.exact_dedup(frame.limit(0)).count() == 0 and exact.exact_groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most_keys", [None, 0])
def test_exact_dedup_of_clashing_columns_and_string_ids(spark, most_keys):
    rows = [("a", "T", 1, "x"), ("b", "t", 1, "x"), ("b", "t", 1, "x"), ("b", "t", 2, "x"), (None, "q", 3, "x"), ("c", "q" * 100_000, 3, "x"), ("d", "Q" * 100_000, 3, "x")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, keep_id int, kept string")
    kept = exact.exact_dedup(frame, most_keys=most_keys)
    assert kept.columns == frame.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(["b", None, "d"])


NASTY = ["__row", "__key", "__full", "__of", "__again", "__too", "__maybe", "__block", "__words", "__lines", "__k", "__id", "__t", "__text", "__n", "__ruled", "__url", "node", "root", "size", "n", "a.b", "a b", "kept", "score", "verdict", "lang_pred"]


def test_further_columns_of_any_name(spark):
    """Operators give what they give without the further columns, and the further columns as they were."""
    words = " ".join(f"w{i % 61}x{i}" for i in range(200))
    rows = [(1, words, "s", "a"), (2, words.upper(), "s", "a"), (3, words + " end", "t", "b"), (4, "", "t", "b"), (5, None, None, None), (6, "one two", "s", "http://x.com/a"), (6, "one two", "s", "http://x.com/a")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    odd = plain.select("*", *[F.lit(k).alias(name) for k, name in enumerate(NASTY)])
    model = crf.trained([("en", ["the", "and"]), ("de", ["der", "und"])])
    passing = {"exact": exact.exact_dedup, "near": simhash.near_dedup, "mix": mixing.mix, "quality": quality.quality_filter}
    told = {"mixed": mixing.mixed, "judged": quality.judged, "urls": urls.judged, "language": lambda df: crf.identified(df, model)}
    for name, operator in (passing | told).items():
        want, got = operator(plain), operator(odd)
        assert name not in passing or got.columns == odd.columns, name
        assert len(set(got.columns)) == len(got.columns) and set(want.columns) <= set(got.columns), name
        pick = lambda df: sorted(tuple(map(str, (r[c] for c in want.columns))) for r in df.collect())  # noqa: B023, E731
        assert pick(want) == pick(got), name
        if name != "mixed":
            rest = [c for c in NASTY if c not in want.columns]
            at = [got.columns.index(c) for c in rest]
            assert {tuple(r[i] for i in at) for r in got.collect()} <= {tuple(NASTY.index(c) for c in rest)}, name


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_matching_by_a_filter_is_the_same_join(spark, how):
    rows = spark.createDataFrame([(k % 50, f"t{k}") for k in range(200)], "k int, text string")
    keys = spark.createDataFrame([(k,) for k in range(0, 80, 3)], "key int")
    told = lambda n: sorted(map(tuple, common.matching(rows, keys, "k", how, n).select("k", "text").collect()))
    assert told(None) == told(0) != []


def test_hot_groups_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = spark.createDataFrame([("hot" if k % 3 else f"k{k % 7}", k) for k in range(90)], "key string, k int")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))
    got = common.with_groups(rows, groups, "key", "n", 90)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, "key").select("key", "k", "n", "last").collect()))


def ratio_of(urls, allow, block):
    """Mean log-likelihood difference by the definition, with counts in dictionaries."""
    pad = lambda u: urls_module.START * 3 + u + urls_module.END
    letters = {c for u in allow + block for c in u + urls_module.END}

    def chance(corpus):
        n = defaultdict(Counter)
        for u in corpus:
            h = pad(u)
            for i in range(3, len(h)):
                for k in range(4):
                    n[h[i - k : i]][h[i]] += 1

        def p(context, c):
            low = 1 / (len(letters) + 1) if not context else p(context[1:], c)
            if not context:
                followers = n[""]
                return (followers[c] + len(followers) * low) / (sum(followers.values()) + len(followers))
            followers = n.get(context)
            return low if not followers else (followers[c] + len(followers) * low) / (sum(followers.values()) + len(followers))

        return p

    a, b = chance(allow), chance(block)
    out = {}
    for u in urls:
        h = pad(u)
        ratios = [round((math.log(a(h[i - 3 : i], h[i])) - math.log(b(h[i - 3 : i], h[i]))) * 1000) for i in range(3, len(h))]
        out[u] = math.floor(sum(ratios) / len(ratios))
    return out


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_url_scores_by_brute_force(spark, monkeypatch, most_keys):
    from zlib import crc32

    monkeypatch.setattr(urls, "MOST_KEYS", most_keys)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé_%7=") for _ in range(rng.randint(1, 5)))
    given = {f"x://{word()}.ex.com/{word()}?q={word()}" for _ in range(60)} | {f"x://{word()}.net/es/{word()}#{word()}" for _ in range(60)} | {f"x://{word()}.org/{word()}?A={word()}" for _ in range(40)}
    rows = [(k, u) for k, u in enumerate(sorted(given))]
    rows += [(k + 1000, u) for k, u in rows[::4]]
    rows += [(5000, "data://" + "ab=é😀%" * 20_000), (5001, "x://q.org/" + "_7" * 50_000)]  # whole, and in time in proportion to their length
    got = urls.judged(spark.createDataFrame(rows, "page_id int, url string")).collect()
    trains = lambda r: r["rule"] and crc32(r["url"].encode()) % urls.HOLD_OUT
    by = {v: [r["url"] for r in got if trains(r) and r["verdict"] == v] for v in (urls.ALLOW, urls.BLOCK)}
    free = {r["url"]: r["score"] for r in got if not r["rule"]}
    exact = ratio_of(sorted(free), by[urls.ALLOW], by[urls.BLOCK])
    assert max(map(len, free)) > 100_000
    assert len(free) > 30 and all(abs(free[u] - exact[u]) <= 1 for u in free)


def test_urls_of_one_verdict_are_allowed(spark):
    rows = [(k, f"x://ex.com/a{k}") for k in range(40)] + [(900, "y://zzz.org/q"), (901, None), (902, ""), (903, "nothing"), (904, "y://z.org/" + "p" * 20_000)]
    got = {r["page_id"]: (r["verdict"], r["score"]) for r in urls.judged(spark.createDataFrame(rows, "page_id int, url string")).filter("page_id >= 900").collect()}
    assert got == {900: ("allow", 0), 901: ("allow", None), 902: ("allow", None), 903: ("allow", 0), 904: ("allow", 0)}


def test_url_parts_and_rules(spark):
    given = [
        ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/z", "x.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
        ("x://example.com", "example.com", "", None, None),
        ("x://a.net/es/q", "a.net", "/es/q", "net/es/", "block"),
        ("x://net/fr/", "net", "/fr/", "net/fr/", "block"),
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("x://h?p/q", "h", "", None, None),
        ("x://h#p/q", "h", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
    ]
    frame = spark.createDataFrame([(k, g[0], "old", 1) for k, g in enumerate(given)] + [(None, given[0][0], "old", 1)], "page_id int, url string, host string, extra int")
    rows = urls.judged(frame).collect()
    assert len(rows) == len(given) + 1 and {"extra", "page_id"} <= set(rows[0].asDict())
    for r in rows:
        if r["page_id"] is not None:
            _, host, path, rule, verdict = given[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert verdict is None or r["verdict"] == verdict
    assert urls.judged(frame.limit(0)).count() == 0


def test_url_model_learns_from_the_rules(spark):
    good = [f"x://ex.com/story/{i}" for i in range(300)]
    bad = [f"x://shop.net/es/zzqq{i}" for i in range(300)]
    free = ["x://site.org/story/77", "x://shop.org/es/zzqq5"]
    rows = urls.judged(spark.createDataFrame([(k, u) for k, u in enumerate(good + bad + free)], "page_id int, url string"))
    got = {r["url"]: r["verdict"] for r in rows.filter("page_id >= 600").collect()}
    assert got == {free[0]: "allow", free[1]: "block"}


def test_counts_equal_the_tokens_of_an_encoder(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice(["word ", "\n", " \n", "é", "\U0001f600", "  ", "12"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["line of words\n" * 5000]
    got = defaultdict(dict)
    for r in tokens.section_tokens(docs(spark, *enumerate(texts))).collect():
        got[r["doc_id"]][r["section"]] = r["n_tokens"]
    for k, text in enumerate(texts):
        raw, at, counts = text.encode(), 0, Counter()
        for token in own.encode_ordinary(text):
            first = raw[: at + 1].rstrip(b"")  # a token counts for the line that holds its first character
            counts[first[:-1].count(b"\n") if len(text) < 1000 else text[:at].count("\n")] += 1
            at += len(own.decode_single_token_bytes(token))
        assert {i: n for i, n in got[k].items() if n} == dict(counts) and len(got[k]) == text.count("\n") + 1


def test_sections_by_each_rule():
    import numpy as np

    first, end = np.array([0, 2, 5]), np.array([2, 5, 9])
    starts, stops = np.array([0, 3, 3, 8]), np.array([3, 3, 8, 9])
    told = {rule: tokens.attributed(first, end, starts, stops, rule)[0].tolist() for rule in tokens.RULES}
    assert told == {"first": [2, 0, 1, 0], "last": [1, 0, 1, 1], "majority": [1, 0, 2, 0]}
    assert tokens.attributed(first, end, starts, stops, "first")[1].tolist() == [1, 0, 2, 1]
    assert tokens.attributed(first[:0], end[:0], starts[:0], stops[:0], "last")[0].tolist() == []


def test_token_counts(spark):
    frame = docs(spark, (1, "one two.\nthree\n"), (2, None), (3, "\U0001f600x"), (None, "a"), (None, "a"))
    rows = tokens.section_tokens(frame).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["section"], r["start_char"], r["end_char"], r["n_tokens"], r["doc_tokens"]))
    assert [x[:3] for x in sorted(by[1])] == [(0, 0, 9), (1, 9, 15), (2, 15, 15)] and sum(x[3] for x in by[1]) == by[1][0][4]
    assert by[2] == [(0, 0, 0, 0, 0)] and len(by[None]) == 2 and by[3][0][2] == 2
    parts = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end")))
    own = tokens.section_tokens(frame.filter("doc_id = 1"), sections=parts).collect()
    assert len(own) == 1 and 0 < own[0]["n_tokens"] < own[0]["doc_tokens"]
    assert tokens.section_tokens(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(frame, rule="fair")


CHAT = "conv_id long, turn long, role string, text string, place int"


def conversation(spark, *rows):
    return spark.createDataFrame([(*r, 5) for r in rows], CHAT)


def test_chat_reads_back_what_went_in(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "INST]", " ", "\n", "é", "<<SYS>>", "[ROLE] ", " [/OTHER]", "ok"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "odd", "[ROLE] x", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", None), (None, None, "assistant", "z"), (99, 1, "user", "a"), (99, 1, "user", "a")]
    got = {r["conv_id"]: r for r in chat.digests(chat.running(chat.formatted(conversation(spark, *rows)))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reader_takes_a_text_in_any_pieces():
    rng = random.Random(5)
    turns = [(rng.choice(["user", "assistant", "odd [INST]", ""]), rng.choice(["", "</s>", "a [INST] \\ b", " [/OTHER]"])) for _ in range(30)]
    text, spans = "", []
    for role, said in turns:
        for piece, loss in chat.step(chat.INSTRUCT, "", role, said)[2]:
            if loss:
                spans.append((len(text), len(text) + len(piece)))
            text += piece
    reader, got, under, at = chat.Reader(chat.INSTRUCT), [], [], 0
    while at < len(text):
        n = rng.randint(1, 25)
        more, loss = reader.fed(text[at : at + n], [x for x in spans if at <= x[0] < at + n])
        got, under, at = got + more, under + loss, at + n
    assert got == turns and under == [said for role, said in turns if role == "assistant"] and not reader.held


def test_chat_order_and_spans(spark):
    turns = chat.formatted(conversation(spark, (1, 0, "user", "q"), (1, 1, "user", "again"), (1, 2, "assistant", "</s>")))
    assert [r["allowed"] for r in turns.orderBy("place").collect()] == [True, False, True]
    whole = chat.joined(turns).head()
    assert [chat.INSTRUCT.unescaped(whole["text"][s["start"] : s["end"]]) for s in whole["spans"]] == ["</s>"]
    assert whole["text"].count("</s>") == 1 and chat.formatted(conversation(spark, (1, 0, "user", "q")).limit(0)).count() == 0
    assert chat.digests(chat.running(chat.formatted(chat.probe(spark)))).head()["conv_id"] == -1


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("U ", " U")}, follows={})
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("<u>", "</u>")}, follows={})
