"""A training corpus from raw documents: quality rules, exact dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of docs. Between two
stages the rows are written as Parquet, so a stage that reads its input more than once never runs the one before again,
and executors that are lost cost a stage's tasks at most.

Defined cases, in every stage: an empty table gives an empty table with the columns of docs; texts of any length are read
whole; further columns pass through all stages but the last, whatever their names. What nulls, empty texts, ties and
repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import bpe, exact, mixing, quality, simhash
from fernweave.llm.common import documents, rewritten


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    A null or empty text has no words and goes, as every text of fewer than 50 words does. Each row is judged by itself:
    repeated rows stay or go together, and null ids, sources or labels change nothing.
    """
    return quality.quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id.

    Null and empty texts are equal. A null id is the least; of rows with the largest id one stays, by a hash of all columns,
    and of rows that are equal in all columns one.
    """
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard 0.8 or more), the document with the smallest id.

    A text of fewer than five words is one shingle; texts without words (null and empty ones) are copies of each other. A
    null id comes last, rows with the smallest id are told apart by a hash of all columns, and of rows that are equal in
    all columns one stays.
    """
    return simhash.near_dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    Null is a source of its own, the last. A document without words (null and empty texts) is taken once. Rows of the same
    rank are ordered by id and a hash of all columns; of rows that are equal in all columns as many are taken as come
    nearest to the target. Reruns agree.
    """
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to.

    A null or empty text has no tokens and decodes to no bytes. Each row is encoded by itself, repeated rows and null ids
    too. Further columns do not come out.
    """
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixed_sources),
    ("byte_bpe", byte_bpe),
]

#: SimHash components and Pareto samples aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
