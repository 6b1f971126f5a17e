"""Language ID by a linear-chain conditional random field over the words of a text.

A word (a maximal run of letters, lower-cased) has affix features (its first and last one to three letters), n-gram
features (its letter pairs and triples, ends marked) and lexicon features (in which languages' lexicons it is); weights
of a feature and a label make the word's emission score, and a learned matrix scores the step from one word's label to
the next one's. Labels are languages. Forward-backward gives each word's probabilities in its context, so a text may
switch languages inside; the text's language is the one of greatest mean probability.

Learning. A bounded sample of labelled texts (PER_LANGUAGE for each language, TEXTS in all, distinct texts, chosen by a hash of the
text over all rows) gives windows of words; half of what is trained on is spliced from windows of two languages, from
which steps between languages are learned. The log-likelihood is climbed by AdaGrad, gradients by forward-backward.
Weights are hashed into 2^HASH_BITS rows, so the model is bounded and may be sent to all executors.

Prediction. Whole texts, in slices. A text is cut into blocks of BLOCK words only to order the arithmetic: the product of
a block's step matrices carries the exact messages over it, so all blocks of a slice are computed side by side, and
then each word's probabilities are what one pass along the whole text gives.

Defined cases: a null text, or one without letters, is "und" with score 0; without labelled texts all are; of over
MOST_LANGUAGES labels the most frequent are learned (of equally frequent ones the first in order) and the others are
never predicted; a text of any length is read whole; repeated rows and null ids are judged row by row; an empty table
gives an empty result; further columns pass through, except those with names of output columns. With equal probabilities
the label first in order wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.llm.common import any_columns, cut, slices

UNKNOWN = "und"
#: Bounds of the training sample: texts of a language, texts in all (with many languages each gets fewer), windows of a
#: text, words of a window; and languages at most.
PER_LANGUAGE, TEXTS, WINDOWS, WINDOW, MOST_LANGUAGES = 200, 1000, 3, 32, 200
#: Parts in which a language's texts are looked through for the sample.
SPREAD = 16
#: Words of a language's lexicon at most.
LEXICON = 3000
HASH_BITS = 16
MASK = (1 << HASH_BITS) - 1
#: Words of a block in prediction, and scores of words (a word has one for each label) that a worker remembers.
BLOCK, REMEMBERED = 48, 4_000_000
#: Numbers of the blocks' step matrices (a label by label matrix for each) that are held at a time.
STRIPE = 8_000_000
#: Bytes of text whose probabilities are held at a time, with up to 8 languages; with more, in proportion less.
SLICE = 2_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters; what the pattern lets through besides letters (such as superscript digits) goes."""
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def hashed_features(word: str) -> list[int]:
    """Places of a word's affixes and n-grams in the table of weights."""
    marked = f"^{word}$"
    names = {"p" + word[:1], "p" + word[:2], "p" + word[:3], "s" + word[-1:], "s" + word[-2:], "s" + word[-3:]}
    names.update(map("".join, zip(marked, marked[1:])))  # noqa: B905
    names.update(map("".join, zip(marked, marked[1:], marked[2:])))  # noqa: B905
    return [crc32(x) & MASK for x in map(str.encode, names)]


@dataclass
class Model:
    """labels, weights (2^HASH_BITS x labels), steps (labels x labels), lexicon (word -> labels), and lexicon weights."""

    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray
    lexicon: dict[str, list[int]]
    of_lexicon: np.ndarray
    key: str = field(default_factory=lambda: uuid4().hex)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words' labels: over a word's n-grams and affixes, scaled by their number, and its lexicons."""
        out = np.zeros((len(words), len(self.labels)))
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            places = [hashed_features(w) for w in part]
            sizes = np.fromiter(map(len, places), np.int64, len(part))
            flat = np.fromiter(chain.from_iterable(places), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            out[start : start + len(part)] = sums / np.sqrt(sizes)[:, None]
            for i, word in enumerate(part, start):
                for k in self.lexicon.get(word, ()):
                    out[i] += self.of_lexicon[k]
        return out


def messages(emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages, each scaled to sum to one, and the log of the forward scales: sequences of one length.

    emit: (sequences, words, labels), step: (labels, labels), both exponentials of scores.
    """
    n, length, _ = emit.shape
    forward, backward, scale = np.empty_like(emit), np.empty_like(emit), np.empty((n, length))
    now = emit[:, 0]
    for t in range(length):
        if t:
            now = (forward[:, t - 1] @ step) * emit[:, t]
        scale[:, t] = now.sum(axis=1)
        forward[:, t] = now / scale[:, t, None]
    backward[:, -1] = 1.0
    for t in range(length - 2, -1, -1):
        now = (backward[:, t + 1] * emit[:, t + 1]) @ step.T
        backward[:, t] = now / now.sum(axis=1, keepdims=True)
    return forward, backward, np.log(scale)


def trained(windows: list[tuple[str, list[str]]], epochs: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Model:
    """A model of (label, words) windows."""
    labels = sorted({label for label, _ in windows})
    n, place = len(labels), {label: i for i, label in enumerate(labels)}
    counts = [Counter() for _ in labels]
    for label, words in windows:
        counts[place[label]].update(words)
    lexicon: dict[str, list[int]] = {}
    for k, of in enumerate(counts):
        for word, _ in sorted(((w, c) for w, c in of.items() if c > 1), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, []).append(k)
    model = Model(labels, np.zeros((1 << HASH_BITS, n)), np.zeros((n, n)), lexicon, np.zeros((n, n)))
    if n < 2:
        return model
    chance = np.random.default_rng(seed)
    vocabulary = sorted({w for _, words in windows for w in words})
    index = {w: i for i, w in enumerate(vocabulary)}
    features = [np.array(hashed_features(w)) for w in vocabulary]
    share = np.array([1 / np.sqrt(len(x)) for x in features])
    sequences = []
    full = [(place[label], np.array([index[w] for w in words])) for label, words in windows if len(words) == WINDOW]
    brief = [(place[label], np.array([index[w] for w in words])) for label, words in windows if 0 < len(words) < WINDOW]
    for label, ids in brief:  # repeated to the length of a window
        full.append((label, np.resize(ids, WINDOW)))
    for k, (label, ids) in enumerate(full):
        sequences.append((ids, np.full(WINDOW, label)))
        other_label, other = full[int(chance.integers(len(full)))]
        at = int(chance.integers(4, WINDOW - 4))
        sequences.append((np.concatenate([ids[:at], other[at:]]), np.repeat([label, other_label], [at, WINDOW - at])))
    squared = [np.full(x.shape, 1e-6) for x in (model.weights, model.steps, model.of_lexicon)]
    for _ in range(epochs):
        order = chance.permutation(len(sequences))
        for start in range(0, len(order), batch):
            chosen = [sequences[i] for i in order[start : start + batch]]
            ids, gold = np.stack([x for x, _ in chosen]), np.stack([y for _, y in chosen])
            distinct, inverse = np.unique(ids, return_inverse=True)
            emission = model.emissions([vocabulary[i] for i in distinct])
            step = np.exp(model.steps - model.steps.max())
            emit = np.exp(emission - emission.max(axis=1, keepdims=True))[inverse.reshape(ids.shape)]
            forward, backward, _ = messages(emit, step)
            posterior = forward * backward
            posterior /= posterior.sum(axis=2, keepdims=True)
            # expected steps: a sum of outer products of what leaves a word and what comes to the next, as one product
            leaves, comes = forward[:, :-1].reshape(-1, n), (emit * backward)[:, 1:].reshape(-1, n)
            pairs = step * ((leaves / ((leaves @ step) * comes).sum(axis=1, keepdims=True)).T @ comes)
            off = np.eye(n)[gold] - posterior  # the gradient at each word
            by_word = np.zeros((len(distinct), n))
            np.add.at(by_word, inverse.ravel(), off.reshape(-1, n))
            size = len(chosen)
            rows = np.concatenate([features[i] for i in distinct])
            each = np.repeat(by_word * share[distinct, None], [len(features[i]) for i in distinct], axis=0) / size
            at, back = np.unique(rows, return_inverse=True)
            by_place = np.argsort(back, kind="stable")
            gradient = np.add.reduceat(each[by_place], np.searchsorted(back[by_place], np.arange(len(at))), axis=0)
            squared[0][at] += gradient**2
            model.weights[at] += rate * gradient / np.sqrt(squared[0][at])
            gold_pairs = np.zeros((n, n))
            np.add.at(gold_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
            in_lexicon = np.zeros((n, n))
            for i, word in enumerate(distinct):
                for k in lexicon.get(vocabulary[word], ()):
                    in_lexicon[k] += by_word[i]
            for held, total, gradient in ((model.steps, squared[1], (gold_pairs - pairs) / size), (model.of_lexicon, squared[2], in_lexicon / size)):
                total += gradient**2
                held += rate * 0.3 * gradient / np.sqrt(total)
    model.weights = model.weights.astype(np.float32)
    return model


class Labeller:
    """A model with the emissions of the words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.step = np.exp(model.steps - model.steps.max(initial=0.0)).astype(np.float64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.ones((1024, len(self.model.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Exponentials of the words' scores, a row for each word; new words are scored once and remembered."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED // max(8, len(self.model.labels)):
            self._forget()
            new = set(words)
        if new:
            start = len(self.known)
            if start + len(new) > len(self.table):
                grown = np.ones((2 * (start + len(new)), self.table.shape[1]))
                grown[:start] = self.table[:start]
                self.table = grown
            scores = self.model.emissions(sorted(new))
            self.table[start : start + len(new)] = np.exp(scores - scores.max(axis=1, keepdims=True))
            self.known.update(zip(sorted(new), range(start, start + len(new)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words (not empty) the labels' probabilities at each word, exact along the whole list."""
        step, n = self.step, len(self.model.labels)
        emits = [self.emissions(words) for words in texts]
        blocks = np.array([-(-len(x) // BLOCK) for x in texts])
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        emit, real = np.ones((total, BLOCK, n)), np.zeros((total, BLOCK), dtype=bool)
        for i, own in enumerate(emits):
            emit[first[i] : first[i] + blocks[i]].reshape(-1, n)[: len(own)] = own
            real[first[i] : first[i] + blocks[i]].reshape(-1)[: len(own)] = True
        begins = np.zeros(total, dtype=bool)
        begins[first] = True
        # what comes into each block from the left and from the right; texts side by side, block by block
        left, right = np.ones((total, n)), np.ones((total, n))
        place = np.where(np.repeat(blocks > 1, blocks), np.arange(total) - np.repeat(first, blocks), -1)  # of a block in its text, if there are others
        order = np.argsort(-blocks, kind="stable")
        longer = lambda k: first[order[: np.searchsorted(-blocks[order], -k, "left")]]  # noqa: E731  first blocks of texts of over k blocks
        stripes = self._stripes(blocks)
        held: tuple[np.ndarray, np.ndarray] | None = None
        for low, high in stripes:
            held = self._over(emit, real, np.flatnonzero((place >= low) & (place < high)))
            for k in range(low + 1, min(high, int(blocks.max()) - 1) + 1):
                at = longer(k) + k
                before = left[at - 1][:, None, :] if k > 1 else np.ones((len(at), 1, n))
                arrived = (before @ held[0][held[1][at - 1]])[:, 0] if k > 1 else self._start(emit[at - 1], real[at - 1])
                left[at] = arrived / arrived.sum(axis=1, keepdims=True)
        for low, high in reversed(stripes):
            if len(stripes) > 1:
                held = self._over(emit, real, np.flatnonzero((place >= low) & (place < high)))
            for k in range(min(high, int(blocks.max())) - 2, low - 2, -1):
                if k >= 0:
                    at = longer(k + 1) + k
                    gone = (held[0][held[1][at + 1]] @ right[at + 1][:, :, None])[:, :, 0]
                    right[at] = gone / gone.sum(axis=1, keepdims=True)
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        now = left
        for t in range(BLOCK):
            moved = now if t == 0 else forward[:, t - 1]
            moved = np.where((begins & (t == 0))[:, None], 1.0, moved @ step) * emit[:, t]
            forward[:, t] = moved / moved.sum(axis=1, keepdims=True)
        now = right
        for t in range(BLOCK - 1, -1, -1):
            backward[:, t] = now
            moved = (now * emit[:, t]) @ step.T
            now = np.where(real[:, t, None], moved / moved.sum(axis=1, keepdims=True), now)
        both = forward * backward
        both /= both.sum(axis=2, keepdims=True)
        return [both[first[i] : first[i] + blocks[i]].reshape(-1, n)[: len(words)] for i, words in enumerate(texts)]

    def _stripes(self, blocks: np.ndarray) -> list[tuple[int, int]]:
        """Places of blocks, from and to, whose step matrices in all texts are STRIPE numbers at most, or of one place each."""
        most = max(1, STRIPE // len(self.model.labels) ** 2)
        blocks = np.sort(blocks[blocks > 1])
        if not len(blocks):
            return []
        count = len(blocks) - np.searchsorted(blocks, np.arange(int(blocks.max())), "right")
        out, low, held = [], 0, 0
        for k, c in enumerate(count.tolist()):
            if held and held + c > most:
                out.append((low, k))
                low, held = k, 0
            held += c
        return [*out, (low, len(count))]

    def _over(self, emit: np.ndarray, real: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The message over each chosen block (for each label before it, the scores of the labels at its end), and where a block's is."""
        n = len(self.model.labels)
        over = np.broadcast_to(np.eye(n), (len(chosen), n, n)).copy()
        for t in range(BLOCK):
            moved = (over.reshape(-1, n) @ self.step).reshape(len(chosen), n, n) * emit[chosen, t][:, None, :]
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            over = np.where(real[chosen, t][:, None, None], moved, over)
        where = np.zeros(len(emit), dtype=np.int64)
        where[chosen] = np.arange(len(chosen))
        return over, where

    def _start(self, emit: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The message at the end of blocks that begin a text: no step leads to their first word."""
        now = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, BLOCK):
            moved = (now @ self.step) * emit[:, t]
            now = np.where(real[:, t, None], moved / moved.sum(axis=1, keepdims=True), now)
        return now


_LABELLERS: dict[str, Labeller] = {}


def labeller_of(model: Model) -> Labeller:
    """The labeller of a model, made once in each Python worker, which keeps one only."""
    if model.key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.key] = Labeller(model)
    return _LABELLERS[model.key]


def training_windows(docs: DataFrame, text: str, label: str, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(label, words): windows of a bounded sample of the labelled texts. Equal texts of a label count once.

    The least hashes of each label are found over all rows first, so texts are read again only for the sample.
    """
    labelled = docs.filter(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    # at most MOST_LANGUAGES rows
    frequent = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(MOST_LANGUAGES).select("label")
    frequent = cut(frequent)
    per_language = min(per_language, max(1, TEXTS // max(1, frequent.count())))
    labelled = labelled.join(F.broadcast(frequent), "label", "left_semi")
    # the least hashes of each of SPREAD parts of a label, which hold the least ones of the label
    hashed = labelled.select("label", F.xxhash64("text").alias("h")).distinct().withColumn("part", F.pmod(F.hash("h"), F.lit(SPREAD)))
    rank = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy("h")) <= per_language
    parts = hashed.withColumn("least", rank("label", "part")).filter("least")
    chosen = cut(parts.withColumn("least", rank("label")).filter("least").select("label", "h"))
    # at most per_language * MOST_LANGUAGES rows
    found = labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["label", "h"]).dropDuplicates(["label", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            labels, words = [], []
            for of, h, value in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                own = words_in(value)
                spare = max(len(own) - WINDOW, 0)
                for k in range(WINDOWS):
                    start = (crc32(f"{h}/{k}".encode()) % (spare + 1)) if spare else 0
                    if own and (spare or not k):
                        labels.append(of)
                        words.append(own[start : start + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return found.select("label", "h", "text").mapInArrow(run, "label string, words array<string>")


def learned(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang") -> Model:
    """A model of the rows of docs for which `learn` holds and which have a label."""
    windows = training_windows(docs, text, label, learn).orderBy("label", "words").collect()  # the bounded sample
    return trained([(row["label"], row["words"]) for row in windows])


@any_columns("text")
def identified(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with lang_pred and score (mean probability of that language), and without the text.

    With spans also lang_spans: runs of words of one language, as (lang, first word, words), for code-switched text.
    """
    names = ["lang_pred", "score", "lang_spans"] if spans else ["lang_pred", "score"]
    kept = docs.select(*[c for c in docs.columns if c not in (text, *names)], F.col(text).cast("string").alias("__text"))
    schema = kept.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, labels = labeller_of(sent.value), np.array(sent.value.labels, dtype=object)
        for part in slices(batches, "__text", SLICE * 8 // max(8, len(labels))):
            at = part.schema.get_field_index("__text")
            words = [words_in(x) if x else [] for x in part.column(at).to_pylist()]
            full = [i for i, x in enumerate(words) if x and len(labels)]
            told, score, runs = [UNKNOWN] * len(words), [0.0] * len(words), [[] for _ in words]
            for i, own in zip(full, labeller.posteriors([words[i] for i in full]) if full else (), strict=True):
                mean = own.mean(axis=0)
                best = int(mean.argmax())
                told[i], score[i] = labels[best], float(min(mean[best], 1.0))
                if spans:
                    best_of = own.argmax(axis=1)
                    starts = np.flatnonzero(np.append(True, best_of[1:] != best_of[:-1]))
                    runs[i] = [{"lang": labels[best_of[s]], "first": int(s), "words": int(e - s)} for s, e in zip(starts, [*starts[1:], len(best_of)], strict=True)]
            columns = [c for k, c in enumerate(part.columns) if k != at] + [pa.array(told, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(runs, arrow.field("lang_spans").type))
            yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return kept.mapInArrow(run, schema)
