"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, at most `most` times its own size, the excess reshared by
weight. Within a source a document is expected in proportion to its measure, the number of binary digits of its number
of words (so a document of 1,000 words is expected twice as often as one of 30), but `most` times at most: the factor is
such that the expected words add up to the target. The whole part of what is expected is certain: so many copies are
taken. What remains is the document's inclusion probability p for one copy more. Every document draws a random number u;
documents are ranked by the random odds u / (1 - u) over the inclusion odds p / (1 - p), and the sample is the head of
that ranking: of fixed size in words, ended where the sum comes nearest to what the certain copies leave of the target.

The ranking is cut without sorting a source in one task: ranks fall into bins, words are summed by (source, bin) before
the shuffle, and only rows of the bin in which a source's sample ends are looked at one by one; two levels of bins leave
a 2^-24 part of a source there.

Defined cases: a null text has no words and null is a source of its own, the last; a document without words is taken
once, whatever the mix (it adds no words, and takes 0); texts of any length count whole; rows of the same rank are
ordered by id and a hash of all columns, and of rows that are equal in all columns as many are taken as come nearest, so
reruns agree; an empty table gives an empty result; `mix` passes further columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.common import any_columns, cut, text_or_empty, words_of

#: Most copies of a document, and so the most a target may exceed its source's size.
MOST = 3
#: Rows of a table with a row for each source and measure (of which there are 32) up to which it is broadcast.
MOST_SOURCES = 100_000
#: A source is heavy if it has over one in so many rows.
MOST_HEAVY = 3_000
#: Bits of a bin of one level. Weights repeat in this order over the sources.
BIN_BITS = 12
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.size(words_of(text_or_empty(text))).cast("long")


def measure(size: Column) -> Column:
    """Number of binary digits of a number of words: 0 to 32."""
    return F.when(size > 0, F.char_length(F.bin(size))).otherwise(0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with target, a row for each source.

    With a common level l, a source gets min(most * size, l * weight), and l makes the targets add up to all words. The
    level starts without caps and rises as sources reach theirs, until no further one does; the driver sees sums only.
    Weights go by the places of the sources in code point order: the places of a range, and the ranges before it.
    """
    ranged = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    counted = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("range", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = cut(ranged.join(F.broadcast(starts), "range").select("source", "source_size", weight.alias("w")))
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most < F.lit(level) * F.col("w")
        sums = weighed.agg(
            F.count_if(full).alias("capped"),
            (F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)) * most).alias("left"),
            F.sum(F.when(~full, F.col("w"))).alias("w"),
        ).first()
        if sums["capped"] == capped or not sums["w"]:
            break
        capped, level = sums["capped"], sums["left"] / sums["w"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("w"))
    return weighed.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, row: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id, a hash of the row and the seed only: 52 bits of their md5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(row))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rank_key(u: Column, p: Column) -> Column:
    """The Pareto rank q = odds(u) / odds(p), as q / (1 + q): the same order, within (0, 1)."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with __k: source, size, measure, u, and tie, which tells all but rows apart that are equal in all columns."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    size = n_words(F.col(text))
    tie = F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), row.alias("row"))
    return docs.withColumn("__k", F.struct(F.col(source).alias("source"), size.alias("size"), measure(size).alias("m"), uniform(F.col(doc_id), row, seed).alias("u"), tie.alias("tie")))


def _places(v: Column) -> tuple[Column, Column]:
    """Bin and bin within the bin of a rank in (0, 1)."""
    n = 1 << BIN_BITS
    return F.floor(v * n).cast("int"), F.pmod(F.floor(v * (n * n)).cast("long"), F.lit(n)).cast("int")


def _end(sums: DataFrame, place: str) -> DataFrame:
    """For each source: the place at which the running sum of words reaches `rest`, and what is wanted of that place.

    sums has a row for each source and place: 2^BIN_BITS rows of a source at most.
    """
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(place))
    found = sums.withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    return found.select("source", F.col(place).alias(f"end_{place}"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))


def _by_source(df: DataFrame, table: DataFrame, source: Column, m: Column | None = None) -> DataFrame:
    """df with `__of`, the row of table for the source (and the measure m); broadcast only if the table is small.

    Where it isn't, the rows of sources with over one in MOST_HEAVY of df's rows, which are MOST_HEAVY at most, meet the
    few rows of the table that are theirs by a broadcast, so no source is a hot key of the join for the others.
    """
    held = table.select(F.struct(*table.columns).alias("__of"))
    on = source.eqNullSafe(F.col("__of.source")) if m is None else source.eqNullSafe(F.col("__of.source")) & (m == F.col("__of.m"))
    if table.count() <= MOST_SOURCES:
        return df.join(F.broadcast(held), on, "left")
    counts = cut(df.groupBy(source.alias("__h")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.broadcast(cut(counts.filter(F.col("n") * MOST_HEAVY > total).select("__h", F.lit(True).alias("__heavy"))))
    flagged = df.join(heavy, source.eqNullSafe(F.col("__h")), "left").drop("__h")
    theirs = lambda how: held.join(heavy, F.col("__of.source").eqNullSafe(F.col("__h")), how).select("__of")
    met = flagged.filter("__heavy").drop("__heavy").join(F.broadcast(theirs("left_semi")), on, "left")
    return met.unionByName(flagged.filter("__heavy IS NULL").drop("__heavy").join(theirs("left_anti"), on, "left"))


def expected(sized: DataFrame, aimed: DataFrame, most: int) -> DataFrame:
    """(source, m, source_size, target, sure, p, rest): for each source and measure the certain copies and the probability.

    sized: (source, m, words), at most 33 rows of a source. The factor f makes min(most, f * m) times the words add up to
    the target: measures are capped from the greatest down, and the first place at which the next one isn't over `most`
    gives f. rest: the words that the source's sample is to have.
    """
    both = sized.join(aimed.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    of = Window.partitionBy("source")
    down = of.orderBy(F.col("m").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("words") * F.col("m")).over(of.orderBy("m"))  # this measure and all lesser ones
    factor = F.when(weighed > 0, (F.col("target") - above * most) / weighed)
    fits = F.when(factor * F.col("m") <= most, F.struct(-F.col("m"), factor.alias("f")))
    told = both.withColumn("f", factor).withColumn("f", F.min(fits).over(of)["f"])
    count = F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("f") * F.col("m"), F.lit(float(most)))))
    told = told.withColumn("sure", F.floor(count + 1e-12).cast("long")).withColumn("p", F.greatest(count - F.col("sure"), F.lit(0.0)))
    return told.select("source", "m", "source_size", "target", "sure", "p", F.sum(F.col("p") * F.col("words")).over(of).alias("rest"))


def plan(keyed: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source and measure: source_size, target, certain copies, probability and where the sample ends.

    keyed: (source, size, m, u, tie) for every row. The sample ends at (v, tie) of `stop`; of the n rows that are equal
    to it in all columns it has k.
    """
    sized = cut(keyed.groupBy("source", "m").agg(F.sum("size").alias("words")))
    aimed = targets(sized.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    classes = cut(expected(sized, aimed, most))
    ranked = _by_source(keyed, classes, F.col("source"), F.col("m")).filter((F.col("__of.p") > 0) & (F.col("size") > 0))
    v = rank_key(F.col("u"), F.col("__of.p"))
    bin_, sub = _places(v)
    ranked = ranked.select("source", "size", F.col("__of.rest").alias("rest"), v.alias("v"), "tie", bin_.alias("bin"), sub.alias("sub"))
    ends = cut(_end(ranked.groupBy("source", "rest", "bin").agg(F.sum("size").alias("n")), "bin"))
    within = _by_source(ranked.drop("rest"), ends, F.col("source")).filter("bin = __of.end_bin").withColumn("rest", F.col("__of.rest")).drop("__of")
    subs = cut(_end(within.groupBy("source", "rest", "sub").agg(F.sum("size").alias("n")), "sub"))
    last = _by_source(within.drop("rest"), subs, F.col("source")).filter("sub = __of.end_sub").withColumn("rest", F.col("__of.rest")).drop("__of")
    last = last.groupBy("source", "rest", "v", "tie").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    before = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("v", "tie")) - F.col("n") * F.col("size")
    k = F.least(F.col("n"), F.greatest(F.lit(0), F.round((F.col("rest") - before) / F.col("size")))).cast("long")
    near = last.withColumn("before", before).withColumn("k", k)
    near = near.withColumn("off", F.abs(F.col("before") + F.col("k") * F.col("size") - F.col("rest")))
    stop = near.groupBy("source").agg(F.min(F.struct("off", "v", "tie", "k", "n"))["v"].alias("v"), F.min(F.struct("off", "v", "tie", "k", "n")).alias("best"))
    stop = stop.select("source", F.struct("best.v", "best.tie", "best.k", "best.n").alias("stop"))
    for more in (ends.drop("rest"), subs.drop("rest"), stop):
        classes = classes.join(more.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return cut(classes)


def _decided(told: DataFrame) -> DataFrame:
    """told (with __k and __of) with __copies; where the sample ends among equal rows, these have only their certain ones."""
    of, k = F.col("__of"), F.col("__k")
    v = rank_key(k["u"], of["p"])
    bin_, sub = _places(v)
    here, stop = F.struct(v.alias("v"), k["tie"].alias("tie")), F.struct(of["stop"]["v"].alias("v"), of["stop"]["tie"].alias("tie"))
    head = (here < stop) | ((here == stop) & (of["stop"]["k"] == of["stop"]["n"]))
    sampled = (bin_ < of["end_bin"]) | ((bin_ == of["end_bin"]) & ((sub < of["end_sub"]) | ((sub == of["end_sub"]) & F.coalesce(head, F.lit(False)))))
    shared = (of["p"] > 0) & (here == stop) & (of["stop"]["k"] > 0) & (of["stop"]["k"] < of["stop"]["n"])
    drawn = (of["p"] > 0) & (k["size"] > 0) & F.coalesce(sampled, F.lit(False))
    return told.withColumns({"__copies": (of["sure"] + drawn.cast("long")), "__shared": F.coalesce(shared, F.lit(False))})


@any_columns("doc_id", "text", "source")
def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, and taken = copies * size."""
    rows = cut(_keyed(docs, doc_id, text, source, seed).select(F.col(doc_id).alias("doc_id"), "__k"))  # no texts
    classes = plan(rows.select("__k.*"), weights, most)
    told = _decided(_by_source(rows, classes, F.col("__k.source"), F.col("__k.m")))
    out = lambda df, copies: df.select("doc_id", F.col("__k.size").alias("size"), F.col("__of.source_size").alias("source_size"), F.col("__of.target").alias("target"), copies.alias("copies"))
    if classes.filter("stop.k > 0 and stop.k < stop.n").isEmpty():
        found = out(told, F.col("__copies"))
    else:  # of rows that are equal in all columns the sample has some: k rows of n get the copy more
        group = told.filter("__shared").groupBy("__k.source").agg(F.first("doc_id").alias("doc_id"), F.first("__k").alias("__k"), F.first("__of").alias("__of"), F.first("__copies").alias("__copies"))
        each = group.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__of.stop.n"))))
        more = out(each, F.col("__copies") + (F.col("i") <= F.col("__of.stop.k")).cast("long"))
        found = out(told.filter("not __shared"), F.col("__copies")).unionByName(more)
    return found.withColumn("taken", F.col("copies") * F.col("size"))


@any_columns("doc_id", "text", "source")
def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken, none of those that are not; the columns of docs.

    The second reading of docs takes its decisions from the rows of its source, so no text is shuffled.
    """
    keyed = _keyed(docs, doc_id, text, source, seed)
    classes = plan(cut(keyed.select("__k.*")), weights, most)
    told = _decided(_by_source(keyed, classes, F.col("__k.source"), F.col("__k.m")))
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    times = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__again")
    found = told.filter("__copies > 0").select(columns, times).select("__row.*")
    if classes.filter("stop.k > 0 and stop.k < stop.n").isEmpty():
        return found
    group = told.filter("__shared").groupBy("__k.source").agg(F.first(columns).alias("__row"), F.first(F.col("__of.stop.k")).alias("__n"))
    more = group.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__again")).select("__row.*")
    return found.unionByName(more)
