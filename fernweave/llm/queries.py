"""The training-data queries, one per operator, each over its whole table; and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bpe, chat, codes, crf, exact, mixing, negatives, quality, shards, simhash, tokens, toxicity, urls
from fernweave.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judged(documents(spark, sf_dir).select("doc_id", "text"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = crf.learned(docs, ~held_out)
    return crf.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return told.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.running(chat.formatted(rows.unionByName(chat.probe(spark)))))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, books = codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return told.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.learned(docs, labels, ~held_out)
    return toxicity.judged(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_language_id, op4_url_filters, op5_exact_dedup, op6_mixing, op7_sharding, op8_simhash, op9_token_counts, op10_chat, op11_vector_codes, op12_hard_negatives, op13_toxicity)}
_SPACE = r"[\x20\x09-\x0D]"


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and floored means, each a table of its own; all pairs of parts and entries, which small tables bear."""
    assigned = """
        d{k} AS MATERIALIZED (SELECT v.row_id, v.part, b.entry, sum((v.c - b.c) * (v.c - b.c)) AS d FROM v JOIN b{k} b ON b.part = v.part AND b.pos = v.pos GROUP BY ALL),
        a{k} AS MATERIALIZED (SELECT row_id, part, min(entry) AS entry, any_value(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY row_id, part) AS least FROM d{k}) x WHERE d = least GROUP BY row_id, part)"""
    refined = """
        m{k} AS (SELECT v.part, a.entry, v.pos, sum(v.c) AS s, count(*) AS n FROM v JOIN a{k} a ON a.row_id = v.row_id AND a.part = v.part GROUP BY ALL),
        b{next} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    steps = [part.format(k=k, next=k + 1) for k in range(rounds) for part in (assigned, refined)] + [assigned.format(k=rounds)]
    return f"""
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS (SELECT row_id, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 4 AS width, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS c FROM kept),
        v AS MATERIALIZED (SELECT row_id, i // width AS part, i % width AS pos, c FROM cells),
        b0 AS (SELECT part, row_id - 1 AS entry, pos, c FROM v WHERE row_id <= 256),{",".join(steps)},
        told AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row_id)
        SELECT k.vec_id, t.code, t.error, CAST(sum(t.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM kept k JOIN told t ON t.row_id = k.row_id"""



SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2) x),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) x WHERE c > 1),
        again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
        m AS (SELECT w.doc_id, t, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     coalesce(a.n, 0) AS n_repeat_words FROM w LEFT JOIN again a ON a.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols * 100 > length(t) * 5 OR n_dup_lines * 2 > len(lines)
                    OR len(regexp_extract_all(t, '\p{{Lu}}')) * 10 > length(t) * 4 OR len(regexp_extract_all(t, '\p{{L}}')) * 2 < length(t)
                    OR word_chars NOT BETWEEN n_words * 2 AND n_words * 25) AS kept
        FROM b""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d""",
    "op10_chat": r"""
        WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        s AS (SELECT *, CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 15 END
                        + length(t) + len(regexp_extract_all(t, '\\')) + len(regexp_extract_all(t, '\[/?(INST|TOOL|ROLE)\]|\[/OTHER\]|</?s>|<</?SYS>>')) AS chars,
                     lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS before FROM r)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
               CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
               count(*) FILTER (NOT ((before IN ('', 'system') AND role = 'user') OR (before = '' AND role = 'system') OR (before IN ('user', 'tool') AND role = 'assistant') OR (before = 'assistant' AND role IN ('user', 'tool')))) AS n_faults
        FROM s GROUP BY conv_id""",
    "op11_vector_codes": _codes_sql(),
    "op12_hard_negatives": """
        WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
                      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM kept),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.c, r.c) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) x WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
              WHERE 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
        SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS place FROM n) x WHERE place <= 10""",
}
