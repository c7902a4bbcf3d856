"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    bpe, decontaminate, hard_negatives, host_rules, jaccard, katz, language_mix, mtree, suffix_dedup, token_frames, toxicity,
    url_rules, whitening,
)
from .common import prepare
from .folds import in_fold

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: The rules of the registered query.
RULES = [
    url_rules.rule("allow", "com/"), url_rules.rule("block", "example.com/en/"),
    url_rules.rule("allow", "www.example.com/en/"), url_rules.rule("block", "net/es/"), url_rules.rule("block", "net/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, folder, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")



def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


def op3_language_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_mix.learn(docs.filter(F.col("doc_id").isNotNull() & ~in_fold("doc_id", 0)))
    found = language_mix.identify(docs, model, ["doc_id"])
    return found.select("doc_id", in_fold("doc_id", 0).alias("held_out"), "lang_pred", "score", "languages")


def op4_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_frames.write_frames(table(spark, folder, "documents"), BYTE_BPE, end_id=0)
    return token_frames.digests(manifest)


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    """Learned from the labels of all folds but the first."""
    labels = table(spark, folder, "labels").filter(~in_fold("doc_id", 0))
    return toxicity.learn(table(spark, folder, "documents"), labels)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(table(spark, folder, "documents"), toxicity_model(spark, folder), ["doc_id"])
    return scored.select("doc_id", in_fold("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), BYTE_BPE)


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    _, found = jaccard.similar_texts(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "copies", "group_id", "n_links")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


def op9_katz(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return katz.train_and_score(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 1), in_fold("doc_id", 1))


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A document's host is its source."""
    judged = host_rules.judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_kept"
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_rules": op1_url_rules, "op2_suffix_dedup": op2_suffix_dedup,
        "op3_language_mix": op3_language_mix, "op4_token_frames": op4_token_frames,
        "op5_toxicity": op5_toxicity, "op6_bpe": op6_bpe,
        "op7_jaccard": op7_jaccard, "op8_decontamination": op8_decontamination, "op9_katz": op9_katz,
        "op10_top_k": op10_top_k, "op11_host_rules": op11_host_rules, "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


OP1_SQL = r"""
WITH parts AS (
    SELECT page_id, strpos(url, '://') AS at, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), cut AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts
), fitted AS (
    SELECT *, '.' || host AS dotted FROM cut
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    END AS rule
    FROM fitted
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


OP10_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP11_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT id, i, [w[i], w[i + 1], w[i + 2]] AS held FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)
), again AS (
    SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, held) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY id
), lines AS (
    SELECT id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
    FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), counted AS (
    SELECT words.id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
    FROM words LEFT JOIN lines ON lines.id = words.id LEFT JOIN repeats ON repeats.id = words.id
), failed AS (
    SELECT source, unnest([
        {rule: 'few_words', f: n_words < 50}, {rule: 'repeat_words', f: 100 * n_repeat_words > 50 * n_words},
        {rule: 'symbols', f: 100 * n_symbols > 10 * n_words}, {rule: 'dup_lines', f: 100 * n_dup_lines > 30 * n_lines},
        {rule: 'word_length', f: word_chars < 3 * n_words OR word_chars > 10 * n_words}
    ], recursive := true)
    FROM counted WHERE source IS NOT NULL
), hosts AS (
    SELECT source, rule, CAST(count(*) AS DOUBLE) AS docs, CAST(count(*) FILTER (f) AS DOUBLE) AS k FROM failed GROUP BY ALL
), sums AS (
    SELECT rule, CAST(count(*) AS DOUBLE) AS h, sum(docs) AS n, sum(docs * docs) AS s2, sum(k) AS k, sum(k * k / docs) AS q
    FROM hosts GROUP BY rule
), spread AS (
    SELECT rule, k / n AS mean, CASE WHEN h > 1 THEN (q - k * k / n) / (h - 1) END AS between_hosts,
        CASE WHEN n > h THEN (k - q) / (n - h) END AS inside, CASE WHEN h > 1 THEN (n - s2 / n) / (h - 1) END AS typical
    FROM sums
), priors AS (
    SELECT rule, mean, CASE WHEN between_hosts > inside
        THEN greatest(0, (between_hosts + (typical - 1) * inside) / (between_hosts - inside) - 1) END AS strength
    FROM spread
), verdicts AS (
    SELECT source, bool_and(CASE WHEN strength IS NULL THEN mean ELSE (k + strength * mean) / (docs + strength) END < 0.5) AS host_kept
    FROM hosts JOIN priors ON hosts.rule = priors.rule GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(host_kept, true) AS kept,
    coalesce(host_kept, true) AS host_kept
FROM counted LEFT JOIN verdicts ON verdicts.source = counted.source
"""

OP12_SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(generate_series(1, least(len(a.v), len(c.v))), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
    WHERE place <= 5
), fitting AS (
    SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fitting WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": OP1_SQL, "op10_top_k": OP10_SQL, "op11_host_rules": OP11_SQL, "op12_hard_negatives": OP12_SQL}
