"""BPE, language ID, mixing, sharding, SimHash: edge cases, brute force and held-out accuracy."""

import base64
import hashlib
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernweave.llm import bpe, common, components, crf, mixing, shards, simhash
from tests.conftest import ROOT, SMALL

DOCS = "doc_id long, text string, lang string, source string, size long, tie int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2) for i, t, s in rows], DOCS)


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, tiktoken_encoding):
    rng = random.Random(1)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "\U0001f600", "'s", "12", "--", "<|endoftext|>", "\u3000", "\u00a0", "ß", "X"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["", None, "a" * 3000, " " * 500, "ab" * 2000, "\x00\x01", "\n\n\n"] + ["same text"] * 3
    rows = bpe.round_trip(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)]), with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = tiktoken_encoding.encode_ordinary(t)
        assert list(r["token_ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_memory_is_bounded(monkeypatch, tiktoken_encoding):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 200_000)
    own = bpe.Bpe(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rng = random.Random(2)
    for _ in range(30):
        texts = [("\t" if k % 2 else "  ").join(f"w{rng.randrange(10**5)}" for _ in range(60)) + " " + "é" * 90 for k in range(20)]
        ids, at = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
        assert own.held <= 200_000 + 600_000 and max(map(len, own.known)) <= bpe.REMEMBERED_CHARS + 1
        assert len(own.known) * bpe.OVERHEAD <= max(own.held, 1)


def test_bpe_holds_a_small_part_of_a_batch(tiktoken_encoding):
    """Workers of the pipeline's last stage took some 300 MB each, which with the heap was more than an executor has."""
    import public_tokenizers as P

    own = bpe.Bpe(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**3)}" for _ in range(500)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        ids = [x for part in bpe.both_ways(iter([batch]), own, True) for x in part.column(4).to_pylist()[:1]]
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert ids[0] == tiktoken_encoding.encode_ordinary(texts[0])
    assert most < 60


def test_bpe_encode_then_decode(spark):
    frame = docs(spark, (1, "über uns", "s"), (None, "x", "s"), (2, None, "s"))
    back = bpe.decode(bpe.encode(frame))
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"]).decode()) for r in back.collect()) == [(0, "x"), (1, "über uns"), (2, "")]
    assert bpe.encode(frame.limit(0)).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")).head()["bytes"]) == b""


def test_language_of_held_out_documents(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = crf.learned(frame, ~held)
    told = crf.identified(frame.filter(held), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in told) >= 0.95 * len(told) and all(0 <= r["score"] <= 1 for r in told)
    texts = {r["lang"]: r["text"] for r in frame.filter("length(text) > 900").collect()}
    mixed = " ".join(" ".join(texts[k].split()[:60]) for k in ("de", "en", "fr"))
    odd = spark.createDataFrame([(1, None, 7), (2, "12 ² _ !", 7), (3, mixed, 7), (3, mixed, 7)], "doc_id long, text string, score int")
    got = crf.identified(odd, model, spans=True).collect()
    assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] < 3] == [("und", 0.0)] * 2
    spans = [s for s in got[-1]["lang_spans"] if s["words"] >= 20]
    assert [s["lang"] for s in spans] == ["de", "en", "fr"] and sum(s["words"] for s in got[-1]["lang_spans"]) == len(crf.words_in(mixed))
    assert crf.identified(odd.limit(0), model).count() == 0


def test_language_without_labels(spark):
    frame = docs(spark, (1, "a b", "s")).withColumn("lang", F.lit(None).cast("string"))
    model = crf.learned(frame, F.lit(True))
    assert [(r["lang_pred"], r["score"]) for r in crf.identified(frame, model).collect()] == [("und", 0.0)]


@pytest.mark.parametrize("stripe", [crf.STRIPE, 1, 12])
def test_blocks_and_stripes_change_no_probability(monkeypatch, stripe):
    monkeypatch.setattr(crf, "STRIPE", stripe)
    rng = random.Random(8)
    windows = [(k, [rng.choice(v) for _ in range(crf.WINDOW)]) for k, v in (("a", ["ka", "ko", "ki"]), ("b", ["lu", "li", "ka"])) for _ in range(20)]
    labeller = crf.Labeller(crf.trained(windows))
    texts = [[rng.choice(["ka", "lu", "xx", "ko"]) for _ in range(n)] for n in (1, crf.BLOCK - 1, crf.BLOCK, crf.BLOCK + 1, 5 * crf.BLOCK + 3)]
    for text, got in zip(texts, labeller.posteriors(texts), strict=True):
        forward, backward, _ = crf.messages(labeller.emissions(text)[None], labeller.step)
        exact = (forward * backward)[0]
        assert np.allclose(got, exact / exact.sum(axis=1, keepdims=True))


def test_probabilities_are_sums_over_all_label_sequences():
    from itertools import product

    rng = np.random.default_rng(4)
    emit, step = rng.uniform(0.1, 2, (5, 3)), rng.uniform(0.1, 2, (3, 3))
    exact = np.zeros((5, 3))
    for labels in product(range(3), repeat=5):
        score = np.prod([emit[t, k] for t, k in enumerate(labels)]) * np.prod([step[a, b] for a, b in zip(labels, labels[1:], strict=False)])
        for t, k in enumerate(labels):
            exact[t, k] += score
    model = crf.Model(["a", "b", "c"], np.zeros((1 << crf.HASH_BITS, 3)), np.log(step), {}, np.zeros((3, 3)))
    labeller = crf.Labeller(model)
    labeller.emissions = lambda words: emit
    assert np.allclose(labeller.posteriors([list("vwxyz")])[0], exact / exact.sum(axis=1, keepdims=True))


def test_many_labels_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(crf, "MOST_LANGUAGES", 2)
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("ka ko ki " * 20, "a")] * 9 + [("lu li la " * 20, "b")] * 8 + [("zu zi za " * 20, "junk")] * 3)]
    rows = [(i, t + f" {'xyz'[i % 3] * 3}", lang) for i, t, lang in rows] + [(99, "ka ko ki " * 20_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r["doc_id"]: r["lang_pred"] for r in crf.identified(frame, crf.learned(frame, F.lit(True))).collect()}
    assert {told[i] for i in range(9)} == {"a"} and {told[i] for i in range(9, 17)} == {"b"} and told[99] == "a" and set(told.values()) == {"a", "b"}


def test_two_hundred_labels_train_within_memory():
    """In a process of its own, whose peak is its own: as many labels as are allowed, as many texts as the sample holds."""
    code = """
import random, resource, sys
sys.path.insert(0, "ROOT")
from fernweave.llm import crf
rng = random.Random(1)
vocabulary = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(200)}
windows = [(f"l{k:03}", [rng.choice(vocabulary[k]) for _ in range(crf.WINDOW)]) for k in range(200) for _ in range(crf.TEXTS // 200)]
model = crf.trained(windows)
labeller = crf.Labeller(model)
hit = sum(model.labels[labeller.posteriors([[rng.choice(vocabulary[k]) for _ in range(40)]])[0].mean(axis=0).argmax()] == f"l{k:03}" for k in range(200))
labeller.posteriors([[rng.choice(vocabulary[k % 200]) for k in range(20_000)]])
print(hit, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    told = subprocess.run([sys.executable, "-c", code.replace("ROOT", ROOT)], capture_output=True, text=True, timeout=900, check=True).stdout.split()
    assert int(told[0]) >= 190 and int(told[1]) < 1024


def aimed(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, share = total - sum(most * sizes[n] for n in capped), sum(w[n] for n in names if n not in capped)
        more = {n for n in names if n not in capped and share and rest * w[n] / share > most * sizes[n]}
        if not more:
            return {n: most * sizes[n] if n in capped else rest * w[n] / share for n in names}
        capped |= more


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["big"] * 30 + ["a", "b", None, "tiny"])) for i in range(3000)]
    frame = docs(spark, *rows)
    got = mixing.mixed(frame).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(words(t))
    target = aimed(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed(frame.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    copies = Counter(r["doc_id"] for r in mixing.mix(frame).collect())
    assert all(copies[r["doc_id"]] == r["copies"] for r in got) and mixing.mix(frame).columns == frame.columns


def test_mix_of_many_sources_one_of_them_heavy(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "ab cd " * (1 + k % 9), None if k % 11 == 0 else "big" if k % 3 else f"s{k % 40:02}") for k in range(600)], "doc_id long, text string, source string")
    told = lambda: sorted(map(tuple, mixing.mixed(rows).collect()))
    few = told()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert told() == few  # big is heavy, met by a broadcast
    monkeypatch.setattr(mixing, "MOST_HEAVY", 1)
    assert told() == few  # none is


def test_mix_of_odd_tables(spark):
    assert mixing.mixed(docs(spark, (1, "a", "s")).limit(0)).count() == 0 and mixing.mix(docs(spark, (1, "a", "s")).limit(0)).count() == 0
    none = mixing.mixed(docs(spark, (1, None, None), (2, "", "s"))).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in none] == [(0, 0, 0.0)] * 2
    twins = mixing.mixed(docs(spark, *[(None, "a b c", "s")] * 4, (5, "x " * 50, "t"))).collect()
    assert len(twins) == 5 and sum(r["taken"] for r in twins if r["size"] == 3) <= 36


def expected_copies(sizes, target, most=3):
    """Copies that are expected of documents of one source, by bisection of the factor."""
    m = [len(bin(n)) - 2 if n else 0 for n in sizes]
    low, high = 0.0, 1e9
    for _ in range(200):
        f = (low + high) / 2
        low, high = (f, high) if sum(n * min(most, f * k) for n, k in zip(sizes, m, strict=True)) < target else (low, f)
    return [min(most, low * k) if n else 1.0 for n, k in zip(sizes, m, strict=True)]


def test_sample_is_the_head_of_the_pareto_ranking(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * int(2 ** rng.uniform(0, 9))), "ab"[i % 2]) for i in range(600)]
    frame = docs(spark, *rows)
    got = {r["doc_id"]: r for r in mixing.mixed(frame).collect()}
    u = {r["doc_id"]: r["__k"]["u"] for r in mixing._keyed(frame, "doc_id", "text", "source", 1).collect()}
    for source in "ab":
        own = [i for i, _, s in rows if s == source]
        sizes = [got[i]["size"] for i in own]
        counts = expected_copies(sizes, got[own[0]]["target"])
        p = {i: c - int(c + 1e-9) for i, c in zip(own, counts, strict=True)}
        assert len({round(x, 6) for x in p.values()}) > 3
        rest = sum(p[i] * got[i]["size"] for i in own)
        ranked = sorted((i for i in own if p[i] > 1e-9), key=lambda i: u[i] * (1 - p[i]) / ((1 - u[i]) * p[i]))
        sums = np.concatenate([[0], np.cumsum([got[i]["size"] for i in ranked])])
        head = set(ranked[: int(np.argmin(np.abs(sums - rest)))])
        for i, c in zip(own, counts, strict=True):
            assert got[i]["copies"] == int(c + 1e-9) + (i in head)


def test_inclusion_frequencies(spark):
    sizes, copies, times = [5, 10, 20, 40, 80], 100, 40  # the same source many times: ids differ, and so do the draws
    rows = [(c * 1000 + k, " ".join(["w"] * n), f"s{c:03d}") for c in range(copies) for k, n in enumerate(sizes * times)]
    found = mixing.mixed(docs(spark, *rows), weights=(1,)).groupBy(F.col("doc_id") % 1000 % len(sizes)).agg(F.avg("copies").alias("mean")).collect()
    wanted, n = expected_copies(sizes, sum(sizes)), copies * times
    assert len({round(x % 1, 3) for x in wanted}) == len(sizes)
    for r in found:
        want = wanted[r[0]]
        p = want - int(want)
        assert abs(r["mean"] - want) <= 3 * (p * (1 - p) / n) ** 0.5


def test_mix_of_clashing_columns_and_equal_rows(spark):
    names = ["p", "sure", "stop", "end_bin", "end_sub", "m", "size", "u", "target", "copies"]
    rows = [(i % 3 or None, "a b c d", "s", *range(10)) for i in range(300)] + [(500, "x " * 41, "t", *range(10))] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    assert mixing.mixed(frame).columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    taken = Counter()
    for r in mixing.mixed(frame).collect():
        taken[r["source_size"]] += r["taken"]
    target = {r["source_size"]: r["target"] for r in mixing.mixed(frame).collect()}
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    out = mixing.mix(frame)
    assert out.columns == frame.columns and sum(len(r["text"].split()) for r in out.collect()) == sum(taken.values())


def test_shard_of_a_key_by_brute_force(spark):
    from zlib import crc32

    rows = [(i, t, "s") for i, t in enumerate(["a", "b", None, "", "é" * 5000] * 40)] + [(None, "x", "s")]
    got = shards.sharded(docs(spark, *rows)).collect()
    draw = lambda key, k: int(hashlib.md5(f"{key}/{k}".encode()).hexdigest()[:13], 16)
    text = dict((i, t or "") for i, t, _ in rows)
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == max(range(8), key=lambda k: (draw(key, k), -k)) and r["grown_shard"] == max(range(9), key=lambda k: (draw(key, k), -k))
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, crc32(raw))


def test_written_shards(spark, tmp_path):
    frame = docs(spark, *[(i, "t", "s") for i in range(50)])
    shards.write_shards(frame, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    told = {r["doc_id"]: r["shard"] for r in shards.sharded(frame).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == told


def test_shards(spark):
    rows = [(i, t, "s") for i, t in enumerate(["a", "b", None, "", "é"] * 400)] + [(None, "x", "s"), (7, "same", "s"), (7, "same", "s")]
    got = shards.sharded(docs(spark, *rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(map(len, slots.values())) < 1.4 * min(map(len, slots.values()))
    moved = sum(r["grown_shard"] == 8 for r in got)
    assert 0.06 * len(got) < moved < 0.17 * len(got)
    by_size = {r["doc_id"]: r["size"] for r in got}
    assert by_size[2] == 1 and by_size[4] == 3
    assert shards.sharded(docs(spark, (1, "a", "s")).limit(0)).count() == 0


def test_weighted_shards(spark):
    frame = spark.range(4000)
    counts = Counter(r[0] for r in frame.select(shards.shard_of(F.col("id"), [1.0, 3.0])).collect())
    assert 0.7 < counts[1] / 4000 < 0.8


def near(rows, tau):
    from xxhash import xxh64_intdigest

    def fingerprint(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= tau and find(a) != find(b):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(prints))


def varied(rng, n):
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(90)) for _ in range(n // 8)]
    out = []
    for k in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("tau", [3, 9])
def test_components_equal_brute_force(spark, tau):
    rows = [*varied(random.Random(tau), 160), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (None, "one"), (906, "x"), (906, "x")]
    got = simhash.near_components(docs(spark, *[(i, t, "s") for i, t in rows]), tau=tau)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == near(rows, tau)


def test_components_of_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    rows = varied(random.Random(5), 80)
    rows += [(1000 + k, rows[3][1]) for k in range(40)]
    got = simhash.near_components(docs(spark, *[(i, t, "s") for i, t in rows]))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == near(rows, 3)


def test_every_allocation_finds_the_same(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(-(2**62), 2**62, 60)
    flips = [int(x) ^ int(np.bitwise_xor.reduce([1 << int(b) for b in rng.integers(0, 63, k)])) for x in prints for k in range(1, 8)]
    nodes = spark.createDataFrame([(int(x),) for x in {*map(int, prints), *flips}], "f0 long").repartition(3).cache()
    told = lambda **more: {frozenset(g) for g in grouped(components.components(simhash.links(nodes, simhash.Limits(5), **more)))}
    free = told()
    halves = [(list(range(32)), 2), (list(range(32, 64)), 2)]
    thirds = [(list(range(0, 64, 3)), 3), (list(range(1, 64, 3)), 0), (list(range(2, 64, 3)), 0)]
    assert free == told(partitions=halves) == told(partitions=thirds) == told(block=7)


def grouped(found):
    by = defaultdict(set)
    for r in found.collect():
        by[r["root"]].add(r["node"])
    return by.values()


def test_allocation_adds_up():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for n in (1_000, 10**6, 10**10):
        for tau in (3, 12):
            parts = simhash.allocated(n, both * (n / 1000), tau)
            assert sum(t for _, t in parts) == tau - len(parts) + 1 and sorted(b for bits, _ in parts for b in bits) == list(range(64))


def test_bits_that_vary_together_share_a_partition():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 40:44] = x[:, :1]
    both = (x.T @ x).astype(float)
    parts = simhash.grouped_bits(4000, both, 4)
    assert any({0, 40, 41, 42, 43} <= set(p) for p in parts)
    alone, tied = (simhash.chance_within(4000, both, bits, 1)[1] for bits in (list(range(1, 17)), [0, *range(40, 44), *range(1, 12)]))
    assert tied > alone


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    rows = varied(rng, 60)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split())}
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    frame = docs(spark, *[(i, t, "s") for i, t in rows], (None, rows[0][1], "s"), (500, "", "s"), (501, None, "s"), (502, "short text", "s"), (502, "short text", "s"))
    kept = simhash.near_dedup(frame)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == frame.columns and set(got) == {find(i) for i in sets} | {500, 502} and max(got.values()) == 1
    assert simhash.near_dedup(frame.limit(0)).count() == 0


def test_near_dedup_finds_all_pairs_just_above_the_threshold(spark):
    rng, rows, pairs = random.Random(8), [], 0
    while pairs < 200:
        n = rng.choice([12, 30, 80, 200])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(max(1, n // 50)):
            b[rng.choice([0, 1, n - 1, rng.randrange(n)])] = "other"
        b += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(max(2, n // 6)))]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            rows += [(2 * pairs, " ".join(a), "s"), (2 * pairs + 1, " ".join(b), "s")]
            pairs += 1
    rows += [(1000, "line of five words here " * 90 + "x y z", "s"), (1001, "line of five words here " * 3 + "x y z", "s")]
    kept = {r["doc_id"] for r in simhash.near_dedup(docs(spark, *rows)).collect()}
    assert kept == {*range(0, 400, 2), 1000}


def test_prefix_links_are_the_same_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(2**62)) if k % 3 else 7, 1, [int(x) for x in rng.choice(9, 2, replace=False)]) for k in range(90)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, size long, prefix array<long>")
    told = lambda block: {frozenset(g) for g in grouped(components.components(simhash.prefix_links(nodes, simhash.Limits(64, 24), block)))}
    assert told(4096) == told(5) != set()


def test_alike_roots_equal_brute_force():
    rng = np.random.default_rng(2)
    base = [rng.choice(200, 40, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[k % 4], 36, replace=False), rng.choice(300, k % 7)])).astype(np.int64) for k in range(60)]
    got = simhash.alike_roots(sets, 0.8)
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            j = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
            if j >= 0.8 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert {frozenset(np.flatnonzero(got == g)) for g in set(got)} == {frozenset(i for i, x in enumerate(label) if x == g) for g in set(label)}


def test_near_dedup_of_long_texts_clashing_columns_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_BLOCK", 2)
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [("a", long, 1, "n"), ("b", long + " end", 2, "n"), ("b", long + " end", 2, "n"), ("c", long.replace("w7 ", "v7 "), 3, "n"), (None, "other " + " ".join(f"z{i}" for i in range(50)), 4, "n")] + [("d", long, 1, "n")] * 3
    frame = spark.createDataFrame(rows, "doc_id string, text string, root int, node string")
    kept = simhash.near_dedup(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] or "" for r in kept.collect()) == ["", "a"]


@pytest.mark.parametrize("shape", ["path", "star", "ring", "none"])
def test_components_of_shapes(spark, shape):
    n = 200
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "ring": [(i, (i + 1) % n) for i in range(n)], "none": [(3, 3)]}[shape]
    found = components.components(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "u string, v string"))
    assert len(list(grouped(found))) == (shape != "none")
