"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a boolean expression that rejects a row. On a sample the cascade estimates what a rule costs and which rows
it rejects, and then asks the rules in the order of rejections per cost: first the rule that is best by itself, then the
one that is best on the rows that are left, and so on. A row leaves at the first rule that rejects it, so costly rules
see few rows. The order never changes a verdict: a row is kept if no rule rejects it.

Defined cases: a null or empty text has no words, no lines and all measures zero (so the base rule rejects it); a text
of any length is measured whole; repeated rows, ties and null ids are judged row by row; an empty table gives an empty
result; further columns pass through unless they have the name of an output column, which then replaces them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.common import any_columns, let, text_or_empty, words_of

#: Rows, in the mean, of the sample on which costs and selectivities are estimated; how often its rows are repeated for
#: timing; and the seed by which it is drawn from every partition alike.
SAMPLE_ROWS, REPEATS, SEED = 500, 2, 7


@dataclass(frozen=True)
class Facts:
    """What rules read: the text (never null), and columns that hold a measure of it already, by name."""

    text: Column
    known: dict[str, Column] = field(default_factory=dict)

    def of(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text)


@dataclass(frozen=True)
class Rule:
    """name, and a function from a text's facts to "reject", true or false."""

    name: str
    rejects: Callable[[Facts], Column]


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.array_join(words_of(text), "")).cast("long")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def lines_with_a_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_a_word(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by a chained 64-bit hash of their words. Where any hash occurs twice, (hash, place) pairs are
    sorted, the places whose neighbour has the same hash are put in order, and each place p adds the words of
    [p, p + 3) that the place before it has not covered. All steps are O(n log n) in the words of one text.
    """
    none = F.lit(0)

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
        flagged = F.filter(F.transform(pairs, lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"])), lambda i: i.isNotNull())
        return F.sort_array(flagged)

    def covered(sorted_places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("before"), none.alias("sum"))
        step = lambda acc, p: F.struct(p.alias("before"), (acc["sum"] + F.least(F.lit(3), p - acc["before"])).alias("sum"))
        return F.aggregate(sorted_places, start, step, lambda acc: acc["sum"])

    def of_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(covered(let(pairs, places)))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, none).otherwise(let(windows, of_windows))

    return let(words, of_words).cast("long")


#: Measures by name, as functions of a text.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": lambda t: F.size(lines_with_a_word(t)).cast("long"),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda t: n_repeat_words(words_of(t)),
    "n_chars": lambda t: F.char_length(t).cast("long"),
}
BASE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_measures(docs: DataFrame, text: str = "text", lines: str = "__n_lines") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long, and the number of lines with a word."""
    t = text_or_empty(F.col(text))
    split = docs.drop(*[n for n in BASE_MEASURES if n != text]).withColumns({"__words": words_of(t), "__lines": lines_with_a_word(t)})
    measured = split.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": n_symbols(t),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": n_repeat_words(F.col("__words")),
            lines: F.size("__lines").cast("long"),
        }
    )
    return measured.drop("__words", "__lines")


def _chars_of(text: Column, kind: str) -> Column:
    """Code points of text in runs of a kind of character (a regular expression class)."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, kind + "+", ""))


#: The base rules by themselves, then the method's further ones. Thresholds: documented parameters of this rule set.
BASE_RULES = [
    Rule("too_few_words", lambda x: x.of("n_words") < 50),
    Rule("repeated_windows", lambda x: let(words_of(x.text), lambda w: n_repeat_words(w) * 100 > F.size(w) * 50)),
]
FURTHER_RULES = [
    Rule("many_symbols", lambda x: x.of("n_symbols") * 100 > x.of("n_chars") * 5),
    Rule("many_repeated_lines", lambda x: x.of("n_dup_lines") * 2 > x.of("n_lines")),
    Rule("shouting", lambda x: _chars_of(x.text, r"\p{Lu}") * 10 > x.of("n_chars") * 4),
    Rule("few_letters", lambda x: _chars_of(x.text, r"\p{L}") * 2 < x.of("n_chars")),
    Rule("odd_word_length", lambda x: ~x.of("word_chars").between(x.of("n_words") * 2, x.of("n_words") * 25)),
]
RULES = BASE_RULES + FURTHER_RULES


def ordered_by_gain(rules: list[Rule], costs: list[float], verdicts: list[tuple[tuple[bool, ...], int]]) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share of the rows that are left which it rejects), in the order in which the cascade asks.

    verdicts: what the rules say of a row, and how many rows of the sample they say it of. Costs count as the nearest
    power of two, so that small differences of timing do not change the order; ties go by the order of the rules.
    """
    left, waiting, out = list(verdicts), list(range(len(rules))), []
    while waiting:
        rows = sum(n for _, n in left)
        share = {k: sum(n for said, n in left if said[k]) / rows if rows else 0.0 for k in waiting}
        best = max(waiting, key=lambda k: ((share[k] + 1e-4) / 2.0 ** round(log2(max(costs[k], 1e-6))), -k))
        out.append((rules[best], costs[best], share[best]))
        waiting.remove(best)
        left = [(said, n) for said, n in left if not said[best]]
    return out


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, known: Callable[[DataFrame], tuple[DataFrame, dict[str, Column]]] | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds for a pass over the sample, share rejected), in the order in which the cascade asks.

    The sample is drawn where the rows are, of a share that follows from their number, with a seed: nothing is shuffled,
    and the same table gives the same sample. A rule's cost is the time of a job that asks it of the repeated sample,
    less that of a job which asks nothing; each is run once before it is timed, so that no plan is compiled.
    Only the order of evaluation depends on this estimate, never a verdict. known adds the measures that the rows have.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(text_or_empty(F.col(text)).alias("__t")).sample(fraction=share, seed=SEED)
    sample, have = known(sample) if known else (sample, {})
    sample = sample.cache()
    facts = Facts(F.col("__t"), have)
    asked = [F.coalesce(rule.rejects(facts), F.lit(False)) for rule in rules]
    many = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(verdict: Column) -> float:
        taken = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(verdict).alias("n")).first()
            taken.append(time.perf_counter() - began)
        return taken[-1]

    try:
        said = sample.select(F.array(*asked).alias("said")).groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect() if rules else []  # few patterns
        nothing = seconds(F.col("__again") < 0) if rules else 0.0
        costs = [max(seconds(verdict) - nothing, 1e-4) for verdict in asked]
    finally:
        sample.unpersist()
    return ordered_by_gain(rules, costs, [(tuple(row["said"]), row["n"]) for row in said])


def first_rejection(facts: Facts, ordered: list[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does. Later rules are then not evaluated."""
    asked = F
    for rule in ordered:
        asked = asked.when(F.coalesce(rule.rejects(facts), F.lit(False)), F.lit(rule.name))
    return asked.otherwise(F.lit(None).cast("string")) if ordered else F.lit(None).cast("string")


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with rejected_by (name of the rule that ended the cascade, null if kept)."""
    rules = RULES if rules is None else rules
    ordered = [rule for rule, _, _ in estimate(docs, rules, text, sample_rows)]
    return docs.withColumn("rejected_by", first_rejection(Facts(text_or_empty(F.col(text))), ordered))


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    ordered = [rule for rule, _, _ in estimate(docs, RULES if rules is None else rules, text)]
    return docs.filter(first_rejection(Facts(text_or_empty(F.col(text))), ordered).isNull())


@any_columns("text")
def judged(docs: DataFrame) -> DataFrame:
    """docs with the five measures, base_failed, and kept: false if base_failed, else the verdict of the cascade.

    The measures are needed of every row; the cascade's rules read them and don't measure again.
    """
    have = {name: F.col(name) for name in BASE_MEASURES} | {"n_lines": F.col("__n_lines")}
    measured = with_measures(docs.drop("base_failed", "kept", "__n_lines"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    told = [rule for rule, _, _ in estimate(docs, FURTHER_RULES, known=lambda sample: (with_measures(sample, "__t"), have))]
    passed = first_rejection(Facts(text_or_empty(F.col("text")), have), told).isNull()
    return measured.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passed)).drop("__n_lines")
