"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm import (context_mixing, exact_dedup, hard_negatives, lexical_search, packing,
                           personal_data, piece_sampling, prefix_tokens, quality_classifier,
                           quality_rules, secrets, simhash, token_files)
from promolens.llm.columns import fold
from promolens.llm.scratch import folder, table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold() == 0
    found = quality_classifier.quality_scores(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secret_spans(docs, keep_text=False).select("doc_id", *secrets.digest_columns())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep_text=False).select(
        "doc_id", "near.fingerprint", "near.component_id")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_mixing.mixing_scores(docs, fold() != 1).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", "bits_per_byte")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep_text=False).select("doc_id", "dedup.*")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_tokens.token_counts(docs).select("doc_id", "tokens.*")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_sampling.round_trip(docs).select("doc_id", "pieces.*")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, with_ids=False).select("doc_id", *packing.digest_columns())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = table(quality_rules.rule_statistics(docs).drop("text"), "rules")
    cutoffs = quality_rules.certified_cutoffs(stats, _table(spark, sf_dir, "labels"))
    return quality_rules.apply_cutoffs(stats, cutoffs).select("doc_id", "rules.*").drop("shares")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.personal_spans(docs, keep_text=False).select(
        "doc_id", *personal_data.digest_columns())


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = folder(spark, "tokens")
    token_files.write_tokens(docs, path)
    read = token_files.read_tokens(spark, path)
    return token_files.with_crc(read).withColumnRenamed("key", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.ranked(docs, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_secret_scan, op3_simhash_near_dedup, op4_context_mixing,
        op5_exact_dedup, op6_prefix_token_counts, op7_piece_sampling, op8_best_fit_packing,
        op9_quality_rules, op10_personal_data, op11_token_files, op12_hard_negatives,
        op13_lexical_search)}

ORACLE: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM texts WINDOW same AS (PARTITION BY text_sha256)""",
    "op12_hard_negatives": r"""
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op13_lexical_search": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents WHERE text IS NOT NULL),
        sizes AS (SELECT doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        counts AS (
            SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM texts)
            WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals GROUP BY term),
        parts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS part
            FROM counts JOIN weights USING (term) JOIN sizes USING (doc_id), totals)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY sum(part) DESC, doc_id)::INT AS rank,
               doc_id, sum(part)::BIGINT AS score
        FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0
        QUALIFY rank <= 10"""}
