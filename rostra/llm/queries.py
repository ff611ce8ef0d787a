"""Registered queries of the training-data operators: each applies its operator with its
production parameters to its whole table and derives the result columns; DuckDB SQL where
SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, cross_tokenizer, embedding_dedup, exact_dedup, hard_negatives, html_text, license_scan, packing,
               quality_rules, sentencepiece_fst, simhash_dedup, substring_dedup, toxicity)
from .common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_fst.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


@register("op2_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '(<|\[)(\\*)(\|[A-Za-z_0-9]+\|>|/?s>|/?INST\]|</?SYS>>)')) AS body,
         length(role) + len(regexp_extract_all(role, '(<|\[)(\\*)(\|[A-Za-z_0-9]+\|>|/?s>|/?INST\]|</?SYS>>)')) AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(head + body + 24) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    nodes, members = chat_format.prefix_tree(rows)
    return chat_format.read_back(nodes, members).drop("n_shared")


@register("op2_chat_format_places")
def op2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, position ids and intervals of the tree, summed by conversation; op2_chat_format reads back the texts."""
    return chat_format.places(*chat_format.prefix_tree(table(spark, sf_dir, "conversations")))


@register("op3_substring_dedup", r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 12)) AS pos, words FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS win FROM starts
), first_doc AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win)
, covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 12)) AS pos
  FROM windows JOIN first_doc USING (win) WHERE least < doc_id
), each AS (
  SELECT doc_id, unnest(generate_series(1, len(words))) AS pos, unnest(words) AS word FROM w WHERE len(words) > 0
), kept AS (
  SELECT e.doc_id, count(c.pos) AS n_removed,
         coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '') AS txt
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the tree source/language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


@register("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks")


@register("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


@register("op7_simhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted",
        F.size("passages").alias("n_passages"))


@register("op9_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


@register("op10_embedding_dedup", r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
       v.vec_id <= coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id) AS kept
FROM v
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))


@register("op11_quality_rules", rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), spots AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS pos, w FROM p WHERE len(w) >= 3
), win AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, w[pos], w[pos + 1], w[pos + 2]) AS n FROM spots
), rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS q FROM win WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()[]«»“”„…¿¡')) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_no_letter, CAST(len(l) AS BIGINT) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '\|[^|]*\|'))) AS n_table,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·][\x20\x09]'))) AS n_bullet,
         len(list_filter(w, lambda x: suffix(x, '!!') AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_shout
  FROM p LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * n_symbols > n_words OR 10 * n_shout > 3 * n_words OR 5 * n_no_letter > n_words OR 50 * n_stop_words < n_words
            OR (n_lines >= 10 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * n_table > n_lines OR 10 * n_cut > 3 * n_lines
            OR 10 * n_bullet > 9 * n_lines) AS kept,
       n_stop_words, n_lines
FROM m
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept", "n_stop_words", "n_lines")


@register("op13_hard_negatives", r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


@register("op12_cross_tokenizer")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_tokenizer.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
