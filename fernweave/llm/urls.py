"""URL filters: rules by host and path, then a character language-model ratio. Built-in functions only.

The longest fitting rule decides. Where none fits, two smoothed variable-order Markov models, one of URLs that the rules
accept and one of URLs that they reject, are compared over the whole URL, query and fragment included: the mean
log-likelihood difference per character, in thousandths of a nat, must reach a threshold that is calibrated on labelled
URLs held out from the models.

A model predicts a character from the longest context of up to three characters that was seen, interpolated with all
shorter ones (weight of the shorter context: its number of distinct followers, after Witten and Bell); below them lies
the uniform distribution over all characters of the labelled URLs and one unknown. Characters are code points as they
are, but for the scheme and host, whose A-Z are lower-cased. All labelled URLs are counted, and the tables of grams grow
with what they hold: they are joined, not addressed, and broadcast only if they are few.

Defined cases: a null url, or one without "://", has an empty host and path and no rule; a null or empty url is allowed,
without a score. Unless the URLs that train the models have both verdicts every ratio is zero and all other URLs are
allowed; unless those that are held out have both, the threshold is zero. Equal URLs get equal verdicts; a URL of any
length is scored whole; null page_ids and repeated rows are judged row by row; an empty table gives an empty result;
further columns pass through unless they have the name of an output column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import LOWER, MOST_KEYS, UPPER, any_columns, cut, let, with_groups

ALLOW, BLOCK = "allow", "block"
#: Longest context of the models in characters.
ORDER = 3
#: One in so many labelled URLs calibrates the threshold instead of training the models.
HOLD_OUT = 5
#: Control characters that stand for the start and the end of a URL.
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the stated query.
RULES = [
    UrlRule(ALLOW, "com", "/"),
    UrlRule(BLOCK, "example.com", "/en/"),
    UrlRule(ALLOW, "www.example.com", "/en/"),
    UrlRule(BLOCK, "net", "/es/"),
    UrlRule(BLOCK, "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null if none fits. A list of rules is a parameter written by hand."""
    name = verdict = F
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = name.when(fits, F.lit(rule.name)), verdict.when(fits, F.lit(rule.verdict))
    none = F.lit(None).cast("string")
    return (name.otherwise(none), verdict.otherwise(none)) if rules else (none, none)


def whole(url: Column) -> Column:
    """The url with A-Z lower-cased in what is before the path."""
    origin = F.regexp_extract(url, "^[^:]*://[^/?#]*", 0)
    return F.concat(F.translate(origin, UPPER, LOWER), F.substring(url, F.char_length(origin) + 1, F.char_length(url)))


def grams(url: Column) -> Column:
    """For each character of url and its end: the three before it and itself, as one string."""
    # the string is made and cut once: taking a substring for each character would cost the square of the length
    characters = F.regexp_extract_all(F.concat(F.lit(START * ORDER), whole(url), F.lit(END)), F.lit("(?s)."), F.lit(0))
    return let(characters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)])))


def model(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for the wanted grams: the log-likelihood difference in thousandths of a nat.

    counts: (gram, a, b), how often accepted and rejected URLs have it. Level by level, from no context up to ORDER
    characters, a row for each string that a wanted or a counted gram ends in: its counts, those of its context, and the
    probabilities of the level below.
    """
    both = counts.unionByName(wanted.select("gram", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    both = cut(both.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    below = None
    for order in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        level = both.groupBy(tail.alias("s")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substring("s", 1, order)
        sums = [f(x).alias(k + x) for x in "ab" for k, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]
        if below is None:
            everything = level.agg(*sums, (F.count_if(F.col("a") + F.col("b") > 0) + 1).alias("letters")).first()
            level = level.withColumns({k: F.lit(everything[k]) for k in ("na", "ta", "nb", "tb")} | {"qa": F.lit(1.0 / everything["letters"]), "qb": F.lit(1.0 / everything["letters"])})
        else:
            of = level.groupBy(context.alias("c")).agg(*sums)
            level = level.withColumn("c", context).join(of, "c").withColumn("r", F.substring("s", 2, order)).join(below, "r")
        seen = lambda x: (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))
        chance = {f"p{x}": F.when(F.col(f"n{x}") > 0, seen(x)).otherwise(F.col(f"q{x}")) for x in "ab"}
        level = level.withColumns(chance)
        below = cut(level.select(F.col("s").alias("r"), F.col("pa").alias("qa"), F.col("pb").alias("qb")))
    return below.select(F.col("r").alias("gram"), F.round((F.log("qa") - F.log("qb")) * 1000).cast("long").alias("ratio"))


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """urls (url, each once) with score: mean ratio per character (and end), in thousandths of a nat, rounded down.

    Grams are counted before they meet the model. Its table is broadcast if it is small; else it is joined by shuffle,
    and grams that are in very many URLs meet it by a broadcast of their own.
    """
    each = urls.select("url", F.explode(grams(F.col("url"))).alias("gram"))
    occurring = cut(each.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")))
    table = cut(model(counts, occurring).join(occurring, "gram"))
    if table.count() <= MOST_KEYS:
        met = each.join(F.broadcast(table), "gram")
    else:
        met = with_groups(each, table, "gram", "rows", table.agg(F.sum("rows")).first()[0])
    return met.groupBy("url").agg(F.floor(F.sum("ratio") / F.count(F.lit(1))).cast("long").alias("score"))


def _times(verdict: str) -> Column:
    """Number of URLs of a verdict, from rows that stand for n URLs each."""
    return F.coalesce(F.sum(F.when(F.col("ruled") == verdict, F.col("n"))), F.lit(0))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which URLs are kept, so that the share of accepted URLs kept less that of rejected ones is greatest.

    Scores are binned by 10 and clipped to +-20,000, so the table that is ordered has at most 4,001 rows. The threshold
    lies halfway between the best bin and the next lower one that has URLs, where nothing was seen.
    """
    bins = scored.groupBy(F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") / 10))).cast("long").alias("bin")).agg(
        _times(ALLOW).alias("a"), _times(BLOCK).alias("b")
    )
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("bin").desc())
    all_of = Window.partitionBy(F.lit(0))
    lower = F.coalesce(F.lead("bin").over(up) + 1, F.col("bin"))
    sums = bins.select("bin", lower.alias("lower"), F.sum("a").over(up).alias("a"), F.sum("b").over(up).alias("b"), F.sum("a").over(all_of).alias("na"), F.sum("b").over(all_of).alias("nb"))
    gain = F.col("a") * F.col("nb") - F.col("b") * F.col("na")
    between = F.floor((F.col("bin") + F.col("lower")) * 5)
    return sums.agg(F.coalesce(F.max_by(F.when(F.least("na", "nb") > 0, between).otherwise(0), F.struct(gain, -F.col("bin"))), F.lit(0)).cast("long").alias("t"))


@any_columns("url")
def judged(pages: DataFrame, rules: list[UrlRule] | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score (null where a rule decides) and verdict."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url))
    parsed = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "__ruled": ruled})
    # Equal URLs share a verdict: they are counted before the shuffle and judged once.
    filled = parsed.filter((F.col(url) != "") & F.col(url).isNotNull())
    urls = filled.groupBy(F.col(url).alias("url"), F.col("__ruled").alias("ruled")).agg(F.count(F.lit(1)).alias("n"))
    # small rows that grow by what is made of them: a given number of partitions keeps them from being put together
    urls = cut(urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = F.crc32(F.col("url")) % HOLD_OUT == 0
    trained = urls.filter(F.col("ruled").isNotNull() & ~held)
    counts = cut(trained.select("ruled", "n", F.explode(grams(F.col("url"))).alias("gram")).groupBy("gram").agg(_times(ALLOW).alias("a"), _times(BLOCK).alias("b")))
    free = F.col("ruled").isNull()
    both = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    rest = urls.filter(free | held)
    told = cut(rest.join(scored(rest.select("url"), counts), "url")) if both["a"] and both["b"] else rest.withColumn("score", F.lit(0).cast("long"))
    limit = threshold(told.filter(~free)).first()["t"]
    verdicts = cut(told.filter(free).select(F.col("url").alias("__url"), "score", F.col("n").alias("__n")))
    total = verdicts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    asks = F.col("__ruled").isNull() & F.col(url).isNotNull() & (F.col(url) != "")
    given = parsed.filter(~asks).select(*parsed.columns, F.lit(None).cast("long").alias("score"), F.coalesce("__ruled", F.lit(ALLOW)).alias("verdict"))
    found = with_groups(parsed.filter(asks), verdicts.withColumnRenamed("__url", url), url, "__n", total).drop("__n")
    found = found.withColumn("verdict", F.when(F.col("score") >= limit, F.lit(ALLOW)).otherwise(F.lit(BLOCK)))
    return given.unionByName(found).drop("__ruled")
