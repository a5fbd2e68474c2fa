"""The queries of this subpackage: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import hashed_features as hf
from kinfold.llm import decontamination, divergence, jaccard_join, language_id, language_model, merkle, mixing, quality_classifier, quality_rules, simhash, substring_dedup, url_filter, warc
from kinfold.runtime import scratch_path, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.production_list(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = hf.crc_fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), hf.crc_fold(F.col("doc_id"), 10) == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = hf.crc_fold(F.col("doc_id"), 4) == 2
    model = quality_classifier.fit(docs, labels, F.col("doc_id").isNotNull() & ~held_out)
    return quality_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(warc.records_of(table(spark, sf_dir, "pages")), path)
    read = warc.read_archive(spark, path, payload="verify")
    return read.select(
        warc.page_number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.proofs(table(spark, sf_dir, "documents"), tampered)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter,
            op2_language_id,
            op3_simhash,
            op4_language_model,
            op5_quality_classifier,
            op6_decontamination,
            op7_substring_dedup,
            op8_warc,
            op9_quality_rules,
            op10_mixing,
            op11_divergence_audit,
            op12_merkle_manifest,
            op13_jaccard_join,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op6_decontamination": decontamination.SQL,
        "op7_substring_dedup": substring_dedup.SQL,
        "op8_warc": warc.SQL,
        "op10_mixing": mixing.SQL,
        "op11_divergence_audit": divergence.SQL,
        "op12_merkle_manifest": merkle.SQL,
        "op13_jaccard_join": jaccard_join.SQL,
    }
