"""Toxicity: terms of a learned lexicon, misspelled ones too, weighed by what stands around them.

The lexicon. Over all labelled texts that may be learned from (equal texts with one label count once) it is counted in how
many toxic and how many other ones each word, and each beginning of a word, occurs. Terms are those whose rates differ
most (likelihood ratio), if they are at least LIFT times as frequent in toxic texts: whole words, and stems, which any
ending may follow. What stands between the same two words again and again is the text of near copies and no term, so a term
counts once for each pair of neighbours, DIVERSE of its texts must differ in them, and words on either side must differ:
next to a word in which copies differ, one neighbour changes with it. A term that a better one covers is left out. A term
weighs its log odds.

The search. Terms form a trie; a Levenshtein automaton for one edit (terms of SHORT letters or more) or two (LONG or
more), transpositions of neighbours included, is intersected with it. The states of the product are sets of (place in the
trie, edits so far); they are made as words ask for them and kept, so that a word costs a table lookup a letter, and most
words end in the empty state after a few letters. Digits and signs inside a word count as the letters that they stand
for. A misspelling that is itself a word of the texts that aren't toxic is no misspelling: such words, found by running
the vocabulary through the automaton, are exceptions, and what misspellings of a term weigh is their own log odds.

The context. A hit inside quotation marks, or near a word of reporting, counts less; one near a word of address counts
more. A text's features are sums of weights so discounted: in all, in the densest window, by length, and the strongest
hit; what they are worth is learned by logistic regression on a bounded sample.

At scale. Counts are taken in Arrow batches before they are shuffled and cover all labelled texts; MOST_TERMS terms and
MOST_EXCEPTIONS exceptions at most go to the driver and back, with SAMPLE rows of features. Texts are scored where they
are read, in slices, without a shuffle.

Defined cases: a null or empty text scores like any text without hits; without labelled texts of both kinds no term is
learned and the score is the smoothed share of toxic ones, 0 if none is labelled; a text of any length is read whole (a
quotation spans QUOTED characters of one line at most, else its marks count for nothing); a document with several labels is toxic
if one says so; null ids have no label; repeated rows are scored row by row; an empty table gives an empty result; further
columns pass through, except those with names of output columns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.llm.common import MOST_KEYS, any_columns, cut, rewritten, slices

#: Labelled rows whose features the regression is fitted on; terms, and misspellings that are words, at most.
SAMPLE, MOST_TERMS, MOST_EXCEPTIONS = 20_000, 1_000, 50_000
#: What a term needs: toxic texts that hold it, times as frequent there, letters, and the share of its toxic texts that
#: differ in its neighbours; what its likelihood ratio (twice the log) needs above that of the best of as many chance terms.
TOXIC_TEXTS, LIFT, LETTERS, DIVERSE, RATIO = 3, 4.0, 4, 0.3, 2.0
#: Words on each side that are enough, however many texts there are.
SIDES = 30
#: Longest stem; letters from which one edit, and two, are allowed.
STEM, SHORT, LONG = 8, 5, 10
#: Words to each side that are a hit's context; of the densest window; characters of a quotation at most.
CONTEXT, WINDOW, QUOTED = 8, 20, 400
#: By what a hit counts in quotation marks, near a word of reporting, near a word of address.
IN_QUOTES, REPORTED, ADDRESSED = 0.3, 0.6, 1.25
#: States of the automaton and words that a worker remembers.
MOST_STATES, REMEMBERED = 50_000, 400_000
NAMES = ["score", "predicted", "hits"]

# Words that report what others say, words that address the reader, and signs that stand for letters.
REPORTING = set("said says saying wrote writes called calls quote quoted quotes word words term terms slur insult reported sagte sagt schrieb nannte zitat wort begriff dit disait écrit appelé cite mot terme dijo dice escribió llamó cita palabra término".split())
ADDRESSING = set("you your youre yours u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted ustedes vosotros eres".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "?", "#": "?"})

_WORD = re.compile(r"[^\W_]+(?:[*@$#]+[^\W_]+)*")
_QUOTE = re.compile(rf'"[^"\n]{{1,{QUOTED}}}"|“[^”“\n]{{1,{QUOTED}}}”|„[^“”„\n]{{1,{QUOTED}}}[“”]|«[^»«\n]{{1,{QUOTED}}}»')


def folded(text: str) -> str:
    """The text in lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def plain(word: str) -> str:
    """A word with letters in place of the digits and signs between or before letters."""
    return word if word.isalpha() or not any(map(str.isalpha, word)) else word.translate(SIGNS)


class Automaton:
    """Levenshtein automata of all terms at once, intersected with their trie, made as words ask for it.

    A state is a frozenset of (node, edits, letter): with a letter it is the second half of a transposition, which that
    letter completes. terms: (letters, whether a stem).
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0 if len(t) < SHORT else 1 if len(t) < LONG else 2 for t, _ in terms]
        self.stem = [stem for _, stem in terms]
        self.most = [0]  # edits that any term below a node allows
        for i, (letters, _) in enumerate(terms):
            at = 0
            for c in letters:
                self.most[at] = max(self.most[at], self.allowed[i])
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.next[at][c]
            self.most[at] = max(self.most[at], self.allowed[i])
            self.ends[at].append(i)
        self._clear()

    def _clear(self) -> None:
        self.states: list[frozenset] = [frozenset(), self._closed({(0, 0, "")})]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.steps: list[dict[str, int]] = [{}, {}]
        self.found: list[tuple | None] = [None, None]

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With what is reached by letters of a term that the word lacks; the fewest edits for each node only."""
        todo, best = list(items), {}
        while todo:
            node, edits, letter = todo.pop()
            if edits > self.most[node] or best.get((node, letter), 9) <= edits:
                continue
            best[node, letter] = edits
            if not letter:
                todo.extend((child, edits + 1, "") for child in self.next[node].values())
        return frozenset((node, edits, letter) for (node, letter), edits in best.items())

    def _after(self, state: int, c: str) -> int:
        out = set()
        for node, edits, letter in self.states[state]:
            if letter:
                if letter == c:
                    out.add((node, edits, ""))
                continue
            if c in self.next[node]:
                out.add((self.next[node][c], edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                for x, child in self.next[node].items():
                    out.add((child, edits + 1, ""))
                    if x != c and c in self.next[child]:
                        out.add((self.next[child][c], edits + 1, x))
        new = self._closed(out)
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
            self.found.append(None)
        self.steps[state][c] = self.number[new]
        return self.number[new]

    def _ended(self, state: int) -> tuple[tuple | None, tuple | None]:
        """The best (edits, term) of the terms that end here, and of the stems among them."""
        if self.found[state] is None:
            fits = [(edits, i) for node, edits, letter in self.states[state] if not letter for i in self.ends[node] if edits <= self.allowed[i]]
            self.found[state] = (min(fits, default=None), min((x for x in fits if self.stem[x[1]]), default=None))
        return self.found[state]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the term that the word is, or that it begins with, in the fewest edits; of equal ones the first term."""
        if len(self.states) > MOST_STATES:
            self._clear()
        state, best = 1, None
        for c in word:
            step = self.steps[state].get(c)
            state = self._after(state, c) if step is None else step
            if not state:
                return best
            stem = self._ended(state)[1]
            if stem is not None and (best is None or stem < best):
                best = stem
        last = self._ended(state)[0]
        return last if best is None or (last is not None and last < best) else best


@dataclass
class Model:
    """terms (letters, stem, weight, weight of a misspelling), exceptions, and the regression's mean, spread and weights."""

    terms: list[tuple[str, bool, float, float]]
    exceptions: set[str]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -math.inf
    key: str = field(default_factory=lambda: uuid4().hex)


FEATURES = 7


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = Automaton([(t, stem) for t, stem, *_ in model.terms])
        self.known: dict[str, tuple[int, int] | None] = {}

    def hit(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of a word, None where it is no term's."""
        if word in self.known:
            return self.known[word]
        letters = plain(word)
        found = self.automaton.match(letters)
        if found is not None:
            found = (max(found[0], int(letters != word)), found[1])
            if found[0] and (word in self.model.exceptions or self.model.terms[found[1]][3] <= 0):
                found = None
        if len(word) <= 32:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def hits(self, text: str) -> tuple[list[dict], int]:
        """The hits of a text (start, end, term, edits, weight, context), and its number of words."""
        low = folded(text)
        words = _WORD.findall(low)
        known, hit = self.known, self.hit
        marked = {w for w in set(words) if (known[w] if w in known else hit(w)) is not None}
        if not marked:
            return [], len(words)
        spans = [m.span() for m in _WORD.finditer(low)]
        quotes = [m.span() for m in _QUOTE.finditer(low)]
        starts = [s for s, _ in quotes]
        out = []
        for i, w in enumerate(words):
            if w not in marked:
                continue
            edits, term = hit(w)
            near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
            q = bisect_right(starts, spans[i][0]) - 1
            factor = IN_QUOTES if q >= 0 and spans[i][1] <= quotes[q][1] else REPORTED if not REPORTING.isdisjoint(near) else 1.0
            letters, _, exact, other = self.model.terms[term]
            factor *= 1.0 if ADDRESSING.isdisjoint(near) or factor == IN_QUOTES else ADDRESSED
            out.append({"start": spans[i][0], "end": spans[i][1], "term": letters, "edits": edits, "weight": other if edits else exact, "context": factor, "word": i})
        return out, len(words)

    def features(self, text: str) -> tuple[list[float], list[dict]]:
        hits, n = self.hits(text)
        if not hits:
            return [0.0] * FEATURES, hits
        worth = [h["weight"] * h["context"] for h in hits]
        densest = held = 0.0
        first = 0
        for h, w in zip(hits, worth, strict=True):
            held += w
            while hits[first]["word"] <= h["word"] - WINDOW:
                held -= worth[first]
                first += 1
            densest = max(densest, held)
        exact = sum(w for h, w in zip(hits, worth, strict=True) if not h["edits"])
        return [math.log1p(sum(worth)), math.log1p(densest), math.log1p(100 * sum(worth) / (n + 20)), max(worth), math.log1p(exact), math.log1p(len({h["term"] for h in hits})), 1.0], hits

    def scores(self, features: np.ndarray) -> np.ndarray:
        m = self.model
        logit = ((features - m.mean) / m.spread) @ m.weights + m.bias
        return np.where(np.isneginf(logit), 0.0, 1 / (1 + np.exp(-np.clip(logit, -40, 40))))


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """The scorer of a model, made once in each Python worker, which keeps one only."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic): the texts that may be learned from, each once for each label, in the shared folder. learn: says which rows of docs may."""
    told = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(F.col(label)) > 0).alias("toxic"))
    if told.count() <= MOST_KEYS:
        told = F.broadcast(told)
    own = docs.filter(learn).select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(told, "__id").select("text", "toxic")
    # which copy stays is told by a number of its own, so hashes are shuffled and no texts are
    own = rewritten(own.withColumn("row", F.monotonically_increasing_id()), "toxicity-labelled")
    keys = own.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    copies = cut(keys.filter("n > 1").select("h", "toxic", F.col("row").alias("stays")))
    of = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(copies) if copies.count() <= MOST_KEYS else copies, ["h", "toxic"], "left")
    return of.filter(F.col("stays").isNull() | (F.col("row") == F.col("stays"))).select("text", "toxic")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(term, stem, t, c): in how many toxic and other texts each word and each stem occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts: dict[tuple[str, bool, bool], int] = Counter()
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = {w for w in map(plain, set(_WORD.findall(folded(text)))) if LETTERS <= len(w) <= 32}
                counts.update((w, False, toxic) for w in words)
                counts.update((s, True, toxic) for s in {w[:n] for w in words for n in range(LETTERS, min(STEM, len(w)) + 1)})
            keys = list(counts)
            t = np.array([counts[k] if k[2] else 0 for k in keys], dtype=np.int64)
            c = np.array([0 if k[2] else counts[k] for k in keys], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(t), pa.array(c)], ["term", "stem", "t", "c"])

    counted = texts.select("text", "toxic").mapInArrow(run, "term string, stem boolean, t long, c long")
    return rewritten(counted.groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-words")


def _log_odds(t: float, c: float, toxic: int, other: int) -> float:
    """Of a term's rates in toxic and other texts, smoothed, 5 at most."""
    return min(5.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (other + 1)))


def _ratio(t: Column, c: Column, toxic: int, other: int) -> Column:
    """The likelihood ratio statistic of a term in t of `toxic` and c of `other` texts."""
    share = (t + c) / (toxic + other)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0) + F.when(x < n, (n - x) * F.log((n - x) / (n * (1 - share)))).otherwise(0.0)
    return F.round(2 * (part(t, toxic) + part(c, other)), 6)


def diverse(texts: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """(of, contexts, sides): between how many pairs of neighbours each of the terms stands in toxic texts, and after or before how many words at least."""
    place = {term: i for i, term in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = set()
            for text in part.column(0).to_pylist():
                words = [plain(w) for w in _WORD.findall(folded(text))]
                for i, w in enumerate(words):
                    at = [place[k] for k in ((w, False), *((w[:n], True) for n in range(LETTERS, min(STEM, len(w)) + 1))) if k in place]
                    if at:
                        sides = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
                        found.update((k, *sides) for k in at)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))], ["of", "left", "right"])

    pairs = texts.filter("toxic").select("text").mapInArrow(run, "of int, left string, right string")
    hashed = pairs.select("of", F.xxhash64("left").alias("left"), F.xxhash64("right").alias("right")).distinct()
    return hashed.groupBy("of").agg(F.count(F.lit(1)).alias("contexts"), F.least(F.count_distinct("left"), F.count_distinct("right")).alias("sides"))


def chosen_terms(texts: DataFrame, words: DataFrame, toxic: int, other: int) -> list[tuple[str, bool, float]]:
    """(letters, stem, weight) of the terms, by how well they tell toxic texts."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    tried = words.filter(t >= TOXIC_TEXTS)
    least = RATIO + 2 * math.log(max(tried.count(), 1))
    fits = tried.filter((t * other >= LIFT * (c + 0.5) * toxic)).withColumn("ratio", _ratio(t, c, toxic, other)).filter(F.col("ratio") >= least)
    order = [F.col("ratio").desc(), "stem", F.length("term").desc(), "term"]
    best = fits.orderBy(*order).limit(4 * MOST_TERMS).collect()
    if not best:
        return []
    around = {r["of"]: (r["contexts"], r["sides"]) for r in diverse(texts, [(r["term"], r["stem"]) for r in best]).collect()}  # a row for each of them at most
    rows = []
    for i, r in enumerate(best):
        contexts, sides = around.get(i, (0, 0))
        if contexts >= max(TOXIC_TEXTS, DIVERSE * r["t"]) and sides >= max(TOXIC_TEXTS, min(SIDES, DIVERSE * r["t"])):
            rows.append((r["term"], r["stem"], min(r["t"], contexts), r["c"]))
    again = words.sparkSession.createDataFrame(rows, "term string, stem boolean, t long, c long").withColumn("ratio", _ratio(t, c, toxic, other))
    terms: list[tuple[str, bool, float]] = []
    stems: set[str] = set()
    beginnings: set[str] = set()
    for row in again.filter(F.col("ratio") >= least).orderBy(*order).collect():
        term = row["term"]
        covered = any(term[:n] in stems for n in range(LETTERS, len(term) + 1)) or (row["stem"] and term in beginnings)
        if not covered and len(terms) < MOST_TERMS:
            terms.append((term, row["stem"], _log_odds(row["t"], row["c"], toxic, other)))
            beginnings.update(term[:n] for n in range(LETTERS, len(term) + 1))
            if row["stem"]:
                stems.add(term)
    return terms


def misspelled(words: DataFrame, terms: list[tuple[str, bool, float]], toxic: int, other: int) -> tuple[dict[int, float], set[str]]:
    """What misspellings of each term weigh, and the words that are exceptions: as frequent in texts that aren't toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(t, stem) for t, stem, _ in terms])
        for batch in batches:
            found = [automaton.match(w) for w in batch.column("term").to_pylist()]
            at = [i for i, f in enumerate(found) if f is not None and f[0]]
            of = pa.array([found[i][1] for i in at], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), of], ["term", "t", "c", "of"])

    near = cut(words.filter(~F.col("stem")).select("term", "t", "c").mapInArrow(run, "term string, t long, c long, of int"))
    ordinary = (F.col("c") > 0) & (F.col("t") * other < LIFT * F.col("c") * toxic)
    exceptions = near.filter(ordinary).orderBy(F.col("c").desc(), "term").limit(MOST_EXCEPTIONS).select("term").collect()
    sums = near.filter(~ordinary).groupBy("of").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()  # a row for each term at most
    weights = {i: 0.6 * weight for i, (_, _, weight) in enumerate(terms)}
    weights |= {r["of"]: (4 * weights[r["of"]] + r["t"] * _log_odds(r["t"], r["c"], toxic, other)) / (4 + r["t"]) for r in sums if r["t"] + r["c"] >= 3}
    return weights, {r["term"] for r in exceptions}


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, spread, weights and bias of a logistic regression with a ridge, by Newton's method."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    hold = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w[:-1], float(w[-1])


def learned(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the rows of docs that `learn` holds for and that labels (doc_id, label) has."""
    texts = labelled(docs, labels, learn, doc_id, text, label)
    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not other:
        return Model([], set(), bias=math.log((toxic + 0.5) / (other + 0.5)) if toxic + other else -math.inf)
    words = vocabulary(texts)
    terms = chosen_terms(texts, words, toxic, other)
    weights, exceptions = misspelled(words, terms, toxic, other)
    model = Model([(t, stem, weight, weights[i]) for i, (t, stem, weight) in enumerate(terms)], exceptions)
    share = F.pmod(F.xxhash64("text"), F.lit(toxic + other)) < sample  # some `sample` texts, chosen by themselves
    rows = np.array([[*r["x"], r["toxic"]] for r in features(texts.filter(share), model).orderBy("toxic", "x").limit(2 * sample).collect()])
    if len(rows) and 0 < rows[:, -1].sum() < len(rows):
        model.mean, model.spread, model.weights, model.bias = fitted(rows[:, :-1], rows[:, -1])
    else:
        model.bias = math.log((toxic + 0.5) / (other + 0.5))
    return replace(model, key=uuid4().hex)  # workers may remember the one whose features were fitted


def features(texts: DataFrame, model: Model) -> DataFrame:
    """(x, toxic) of (text, toxic)."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        for part in slices(batches, "text"):
            x = [scorer.features(t)[0] for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1).cast(pa.int32())], ["x", "toxic"])

    return texts.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int")


@any_columns("text")
def judged(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with score and predicted (1 from a score of 0.5 on), without the text.

    With spans also hits: (start, end, term, edits, context) of each hit, in code points, for what is to be shown or cut.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select(*[c for c in docs.columns if c not in (text, *NAMES)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = kept.drop("__text").schema.add("score", "double").add("predicted", "integer")
    if spans:
        schema = schema.add("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("context", T.DoubleType())])))
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        for part in slices(batches, "__text"):
            at = part.schema.get_field_index("__text")
            told = [scorer.features(t) for t in part.column(at).to_pylist()]
            score = scorer.scores(np.array([x for x, _ in told]).reshape(len(told), FEATURES))
            columns = [c for k, c in enumerate(part.columns) if k != at] + [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            if spans:
                columns.append(pa.array([[{k: h[k] for k in ("start", "end", "term", "edits", "context")} for h in hits] for _, hits in told], arrow.field("hits").type))
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return kept.mapInArrow(run, schema)
