"""Vector codes, hard negatives, toxicity: SQL, brute force, edge cases, held-out accuracy."""

import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fernweave.llm import codes, negatives, toxicity
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<float>, label int, ints string, block int, place double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 0.5) for i, v, y in rows], VECTORS)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(SMALL, 'embeddings.parquet')}'")
    expected = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    assert df.columns == expected.columns
    assert sorted(map(tuple, df.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize(("k", "width", "scale"), [(256, 16, 128), (1, 3, 5), (7, 2, 2), (40, 1, 3), (256, 16, 1 << 27), (300, 5, 3)])
def test_va_file_finds_the_nearest_entry(k, width, scale):
    rng = np.random.default_rng(k)
    draw = lambda n: np.clip(np.floor(rng.normal(size=(n, width)) * scale), -(1 << 27), 1 << 27).astype(np.int64)
    entries, queries = draw(k), draw(3000)
    file = codes.VaFile(entries)
    distance = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    at, error = file.nearest(queries)
    assert (at == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    lower, upper = file.bounds(queries)
    assert (lower <= distance).all() and (upper >= distance).all()
    if k == 256 and scale == 128:
        assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.2  # most entries are never compared


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(5, [0.5, -0.25, 1.0, -1.0], 1), (5, [0.5, -0.25, 1.0, -1.0], 1), (2, [0.1, 0.2, -0.3, 0.0], None), (9, [3e30, -3e30, 0.0, 1.0], None), (None, [0.0, 0.0, 0.0, 0.0], 3)]
    bad = [(1, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [1.0, nan, 1.0, 1.0], 1), (6, [1.0, inf, 1.0, 1.0], 1), (7, [], 1), (8, [1.0] * 8, 1)]
    told, books = codes.compressed(vectors(spark, good + bad))
    rows = sorted(told.collect(), key=lambda r: (r["id"] is None, r["id"]))
    assert [r["id"] for r in rows] == [2, 5, 5, 9, None] and books.shape == (4, 5, 1)
    assert rows[1] == rows[2] and all(r["error"] == 0 == r["label_error"] for r in rows)  # as many entries as rows
    assert [r["ints"] for r in codes.decoded(told.filter("id = 2"), books).collect()] == [[102, 204, -308, 0]]
    assert books[0, 3, 0] == 1 << 27 and books[1, 3, 0] == -(1 << 27)
    assert codes.compressed(vectors(spark, good).limit(0))[0].collect() == []
    with pytest.raises(ValueError, match="3 components"):
        codes.compressed(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]))


def test_codes_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 6)), 1)  # few values, so ties
    labels = [int(k) if k else None for k in rng.integers(0, 3, 90)]
    told, books = codes.compressed(vectors(spark, [(i * 7 % 90, v.tolist(), y) for i, (v, y) in enumerate(zip(x, labels, strict=True))]).repartition(3), scale=4, parts=3, entries=8, rounds=3)
    ids = np.arange(90) * 7 % 90
    q = np.floor(4 * x.astype(np.float32).astype(np.float64)).astype(int)
    own = [q[np.argsort(ids)[:8], p * 2 : p * 2 + 2].tolist() for p in range(3)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(3):
        for p in range(3):
            of = [near(v, own[p])[1] for v in q[:, p * 2 : p * 2 + 2].tolist()]
            own[p] = [[int(sum(c)) // of.count(j) for c in zip(*[v for v, o in zip(q[:, p * 2 : p * 2 + 2].tolist(), of, strict=True) if o == j], strict=True)] if j in of else e for j, e in enumerate(own[p])]
    assert books.tolist() == own
    expected = {int(i): [near(v[p * 2 : p * 2 + 2], own[p]) for p in range(3)] for i, v in zip(ids, q.tolist(), strict=True)}
    errors = Counter()
    for i, y in zip(ids, labels, strict=True):
        errors[y] += sum(d for d, _ in expected[int(i)])
    for r in told.collect():
        assert r["code"] == "".join(f"{j:02x}" for _, j in expected[r["id"]]) and r["error"] == sum(d for d, _ in expected[r["id"]]) and r["label_error"] == errors[r["label"]]


def plain_negatives(rows, every=4, positives=3, negatives=2, scale=256):
    x = {i: [math.floor(scale * c) for c in np.float32(v).astype(float).tolist()] for i, v, _ in rows}
    of = {i: str(y) for i, _, y in rows}
    out = []
    for a in sorted(i for i in x if i % every == 0):
        order = sorted(((-sum(p * q for p, q in zip(x[a], x[b], strict=True)), b) for b in x if b != a))
        for s, p in [(s, b) for s, b in order if of[b] == of[a]][:positives]:
            fits = [(t, b) for t, b in order if of[b] != of[a] and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("few", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, few):
    """With tiny blocks and rounds the bounds decide what is read; clusters make them prune."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 3))
    rows = [(int(i), (np.round(centres[i % 5] + rng.normal(size=3) * 0.2, 1)).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    if few:
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
        monkeypatch.setattr(negatives, "STEPS", (1, 2))
        monkeypatch.setattr(negatives, "ANCHORS_A_TASK", 10)
    got = negatives.hard_negatives(vectors(spark, rows).repartition(3), every=4, positives=3, negatives=2)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_bounds_spare_blocks():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (50, 4)) + 1000 * k for k in range(4)])
    pivots = negatives.Pivots(x, int((x**2).sum(axis=1).max()), 4)
    to = pivots.of_rows(x)
    key = to.argmin(axis=1)
    rows = [{"block": k, "pivot": k, "lo": to[key == k, k].min(), "hi": to[key == k, k].max()} for k in range(4)]
    query = x[-1]
    score = int(np.sort(x @ query)[-5])
    asked = negatives.Directory(rows, pivots).asked(query, pivots.of_queries(query[None])[0], [{"slot": 0, "top": None, "low": score}], 0, None)
    assert set(key[np.flatnonzero(x @ query >= score)]) <= set(asked.tolist()) and len(asked) < 4


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    good = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 2), (4, [-1.0, 0.0], 1), (100, [0.0, 1.0], 7)]
    bad = [(None, [1.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 2), (7, [None, 1.0], 2), (8, [], 2), (9, [1.0, 1.0, 1.0], 2), (10, [0.6, 0.0], None)]
    got = negatives.hard_negatives(vectors(spark, good + bad + [good[2], (2, [0.9, 0.0], 3)]))
    # of the rows with id 2 the one with the least label and vector counts; anchor 100 has no other row of its label; 4 scores below 0
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]
    assert negatives.hard_negatives(vectors(spark, good).limit(0)).collect() == []
    huge = [(0, [6e5, 6e5], 1), (1, [6e5, 3e5], 1), (2, [2e5, 2e5], 2)]
    assert [tuple(r) for r in negatives.hard_negatives(vectors(spark, huge)).collect()] == [(0, 1, 1, 2, (1 << 27) * ((1 << 27) + 256 * 300_000), (1 << 27) * 2 * 51_200_000)]


def edits(a, b):
    """Damerau-Levenshtein distance with transpositions of neighbours (each letter edited once)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("states", [50_000, 20])
def test_automaton_equals_the_distance(monkeypatch, states):
    monkeypatch.setattr(toxicity, "MOST_STATES", states)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(word(rng.randint(3, 12)), rng.random() < 0.4) for _ in range(40)]
    automaton = toxicity.Automaton(terms)
    for _ in range(1500):
        w = word(rng.randint(0, 14)) if rng.random() < 0.5 else rng.choice(terms)[0] + word(rng.randint(0, 4))
        found = []
        for i, (t, stem) in enumerate(terms):
            k = min(edits(w[:n], t) for n in range(len(w) + 1)) if stem else edits(w, t)
            if k <= automaton.allowed[i]:
                found.append((k, i))
        assert automaton.match(w) == min(found, default=None), (w, found)


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = entry.queries()["op13_toxicity"](spark, "/root/testdata/sf0.01")
    assert told.columns == ["doc_id", "held_out", "score", "predicted"] and told.count() == docs.count()
    rows = told.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc >= 0.8 and sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.05 * len(clean)


def test_toxicity_of_odd_rows_and_of_context(spark):
    rng = random.Random(5)
    syllables = ["ba", "ko", "li", "mu", "ne", "ra", "si", "tu"]
    prose = lambda n: [("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        words = prose(60)
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dolt" + rng.choice(syllables)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    family = "zorkazorka fimblefamble " + " ".join(prose(40))
    rows += [(1000 + k, family + f" end{k}") for k in range(30)]  # near copies: their rare words are no terms
    labels += [(1000 + k, 1) for k in range(30)] + [(None, 1), (7, None), (4, 0)]
    frame = spark.createDataFrame(rows + [(None, "nitwit")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learned(frame, told, F.lit(True))
    assert {t for t, *_ in model.terms} == {"blockhead", "nitwit", "dolt"} and dict((t, s) for t, s, *_ in model.terms)["dolt"]
    odd = [
        (1, None), (2, ""), (3, "You nitwit, you blockhead!"), (4, "nitwti blokchead"), (5, 'She wrote: "you nitwit, you blockhead" and left.'), (6, "b l a n k " * 50_000 + "nitwit " * 30), (6, "nitwit n1twit"), (None, "ba ko li"),
    ]
    frame = spark.createDataFrame([(i, t, 9, 9) for i, t in odd], "doc_id long, text string, score int, hits int")
    rows = toxicity.judged(frame, model, spans=True).collect()
    assert [r["doc_id"] for r in rows] == [i for i, _ in odd]
    score = [r["score"] for r in rows]
    assert score[0] == score[1] == score[7] < 0.1 and score[2] > 0.5 and score[3] > 0.5 and score[6] > 0.5
    assert score[4] < score[2] and [(h["term"], h["edits"]) for h in rows[3]["hits"]] == [("nitwit", 1), ("blockhead", 1)] and len(rows[5]["hits"]) == 30
    text = odd[2][1]
    assert [text[h["start"] : h["end"]] for h in rows[2]["hits"]] == ["nitwit", "blockhead"] and rows[4]["hits"][0]["context"] == toxicity.IN_QUOTES
    assert toxicity.judged(frame.limit(0), model).collect() == []
    for labels, most in (([], 0.0), ([(3, 1)], 0.8), ([(3, 0)], 0.3)):  # none, or of one kind
        own = toxicity.learned(frame.drop("score", "hits"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        told = {r["score"] for r in toxicity.judged(frame, own).collect()}
        assert len(told) == 1 and 0 <= told.pop() <= most
