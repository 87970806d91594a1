"""The subpackage's queries, as the contracts want them, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import byte_bpe, extraction, packing, resampling, rules, simhash, token_counts, topk, toxicity, warc


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_extraction": op1_extraction,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_packing": op4_packing,
    "op5_resampling": op5_resampling,
    "op6_simhash": op6_simhash,
    "op7_topk": op7_topk,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_rules": op10_rules,
}

_WORD = "[^\x20\x09-\x0D]+"
_KEEP = rules.KEPT_BITS


def _fence_sql(level: str) -> str:
    """Fences of the sketches grouped by the columns of a level ("" for all)."""
    by = f"{level}, " if level else ""
    part = f"PARTITION BY {by}metric"
    return (
        f"(SELECT {by}metric, total, q3 + (1 << greatest(length(bin(q3)) - {_KEEP}, 0)) + {rules.REACH} * (q3 + (1 << greatest(length(bin(q3)) - {_KEEP}, 0)) - q1) AS fence "
        f"FROM (SELECT {by}metric, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 "
        f"FROM (SELECT {by}metric, bucket, sum(sum(n)) OVER ({part} ORDER BY bucket) AS upto, sum(sum(n)) OVER ({part}) AS total FROM sketch GROUP BY {by}metric, bucket) GROUP BY {by}metric))"
    )


_RULES_SQL = (
    "WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents), "
    f"s AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d), "
    "g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS x FROM s WHERE len(w) > 2), "
    "r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1), (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id), "
    "m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, "
    "(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, "
    "(length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{-~]', '', 'g')))::BIGINT AS n_marks, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper FROM s LEFT JOIN r USING (doc_id)), "
    "f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_marks // greatest(word_chars, 1) AS mark_rate, "
    "1000 * n_upper // greatest(word_chars, 1) AS upper_rate, 100 * word_chars // greatest(n_words, 1) AS word_length FROM m), "
    "u AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{k}' AS metric, {k} AS x FROM f" for k in rules.METRICS) + "), "
    f"sketch AS (SELECT lang, source, metric, CASE WHEN x < {1 << _KEEP} THEN x ELSE (x >> (length(bin(x)) - {_KEEP})) << (length(bin(x)) - {_KEEP}) END AS bucket, count(*) AS n FROM u WHERE NOT base_failed GROUP BY ALL), "
    f"own AS {_fence_sql('lang, source')}, by_lang AS {_fence_sql('lang')}, every AS {_fence_sql('')}, "
    f"limits AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.total >= {rules.LEAST_GROUP} THEN o.fence WHEN g.total >= {rules.LEAST_GROUP} THEN g.fence ELSE a.fence END AS most "
    "FROM own o JOIN by_lang g ON o.lang IS NOT DISTINCT FROM g.lang AND o.metric = g.metric JOIN every a ON a.metric = o.metric), "
    "bad AS (SELECT DISTINCT doc_id FROM u JOIN limits q ON u.lang IS NOT DISTINCT FROM q.lang AND u.source IS NOT DISTINCT FROM q.source AND u.metric = q.metric WHERE x > most) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"
)

_WARC_SQL = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), b AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p) "
    "SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (16 >> j) * substring(bits, 5 * k + j + 1, 1)::INT))::INT, 1)), '') AS payload_digest, "
    "CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"
)

_TOPK_SQL = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
    "s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) "
    "SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"
)

#: For the others: DuckDB has no seeded XXH64, no tokenizers, no tag parser, and the models are fitted; tests hold them against brute force.
ORACLE_SQL = {"op2_warc": _WARC_SQL, "op7_topk": _TOPK_SQL, "op10_rules": _RULES_SQL}
