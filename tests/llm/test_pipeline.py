from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernweave.llm import queries
from fernweave.llm.common import rewritten
from tests.conftest import SMALL


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = rewritten(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] >= counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == counts[-1] and last.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_odd_documents_go_through(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    rows = [(1, None, "en", None, 0), (None, long, None, "s", 1), (None, long.upper(), "en", "s", 1), (2, long + " end", "en", None, 1), (3, "", "en", "s", 0), (3, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = rewritten(stage(spark, docs, SMALL), name)
        assert docs.count() <= 3


def test_run(spark):
    assert "token_ids" in corpus_pipeline.run(spark, SMALL).columns


@pytest.mark.parametrize("n", range(1, 14))
def test_each_operator_has_a_query(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def numbers(spark):
    """Vectors without nulls and without components that are no numbers."""
    kept = F.size("embedding") > 0
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").filter(kept & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_keeps_every_row(spark, name):
    rows = queries.QUERIES[name](spark, SMALL)
    if name == "op4_url_filters":
        assert rows.count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    elif name == "op10_chat":
        assert rows.count() == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif name == "op9_token_counts":
        assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    elif name == "op11_vector_codes":
        assert rows.count() == numbers(spark).count()
    elif name == "op12_hard_negatives":
        labelled = numbers(spark).filter("label IS NOT NULL AND vec_id IS NOT NULL").selectExpr("vec_id", "IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label")
        most = labelled.filter("vec_id % 100 = 0").join(labelled.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others")), "label")
        anchors = {r["vec_id"]: min(5, r["others"]) for r in most.collect()}
        pairs = {(r["anchor_id"], r["positive_id"]): r["n"] for r in rows.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        found = Counter(anchor for anchor, _ in pairs)
        assert set(found) <= set(anchors) and all(n <= anchors[a] for a, n in found.items()) and all(1 <= n <= 10 for n in pairs.values())
    else:
        assert rows.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_near_copies_are_found_by_fingerprints_and_the_rest_by_prefixes(spark):
    """Nodes within three bits are linked by the pigeonhole search alone, equal fingerprints too; texts of sets alike at 0.8 are not all."""
    from fernweave.llm import simhash
    from fernweave.llm.components import components

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "node bigint, t string")
    prints = simhash.signatures(docs, "t", simhash.SHINGLE, simhash.GROUPS, simhash.SIMILARITY)
    limits = simhash.Limits(simhash.TAU, simhash.DIFFER, simhash.SIMILARITY)
    roots = {}
    for r in components(simhash.near_links(prints.drop("prefix"), limits)).collect():
        roots.setdefault(r["root"], set()).add(r["node"])
    bits = {r["node"]: r["f0"] for r in prints.collect()}
    near = (bits[0] ^ bits[2]) & (2**64 - 1)
    assert list(roots.values()) == [{0, 1, 2} if near.bit_count() <= simhash.TAU else {0, 1}]
    rest = components(simhash.prefix_links(prints, simhash.Limits(64, simhash.DIFFER, simhash.SIMILARITY))).collect()
    assert {r["node"] for r in rest} == {0, 1, 2}
