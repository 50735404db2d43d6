"""The operators as registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, hard_negatives, html_extract, language_id, media, mixing, near_dedup, pii, pitman_yor, prefix_trie, sentencepiece_codec, substring_dedup, token_counts

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), PIECES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_documents(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir)).drop("digest")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(_documents(spark, sf_dir), PIECES)


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return exact_dedup.exact_duplicates(docs, ("text_sha256",))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_documents(spark, sf_dir))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(_documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_token_counts, op3_mixing, op4_personal_data, op5_repeated_passages, op6_media_columns, op7_sentencepiece, op8_exact_duplicates, op9_language_id, op10_html_extraction,
    op11_lm_scores, op12_hard_negatives, op13_conversation_trie)}
ORACLES = {
    "op8_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
        WITH vectors AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
            FROM vectors a JOIN vectors v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
        positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
               s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) <= 3""",
    "op13_conversation_trie": r"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        heads AS (
            SELECT conv_id, xor(list_reduce(
                       list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
        placed AS (
            SELECT h.conv_id, 0 AS own, t.k, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h
            UNION ALL
            SELECT h.conv_id, 1, t.k, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
        rebuilt AS (
            SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
        paths AS (SELECT * FROM rebuilt UNION ALL SELECT conv_id, 0, [], 0 FROM heads),
        members AS (
            SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
        nodes AS (
            SELECT node, depth, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM members GROUP BY node, depth),
        up AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1),
        children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM up WHERE parent IS NOT NULL GROUP BY ALL),
        full_nodes AS (SELECT u.*, coalesce(c.n, 0) AS n_children FROM up u LEFT JOIN children c ON c.parent = u.node AND c.depth = u.depth),
        below AS (
            SELECT m.node, m.depth, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
            FROM full_nodes f JOIN members m ON m.conv_id = f.node AND m.depth <= f.depth GROUP BY m.node, m.depth)
        SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children,
               b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN below b ON b.node = f.node AND b.depth = f.depth""",
}
