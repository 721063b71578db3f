"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, gif_columns, hard_negatives, html_wrappers, language_gru, line_dedup, minhash_dedup, packing, quality_rules, rans_files, secret_scan, source_audit, source_mix
from .common import materialise, shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack_powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"
    )


def op3_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialise(gif_columns.store_texts(_documents(spark, sf_dir)), "media")
    return gif_columns.media_digests(media)


def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    net = language_gru.fit(docs)
    return language_gru.predict(docs, net).select("doc_id", language_gru.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op8_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/korvane/{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    rans_files.write_ids(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return rans_files.read_ids(spark, path, with_ids=False)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    judged = quality_rules.cascade(docs, keep_metrics=True)
    named = {c: F.col(c) for c in quality_rules.METRICS}
    base = [quality_rules.rejects(r, named) for r in quality_rules.RULES if r.name in quality_rules.BASE]
    failed = F.coalesce(base[0] | base[1], F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_documents(spark, sf_dir))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_powers_of_two": op1_pack_powers_of_two,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_gif_columns": op3_gif_columns,
    "op4_language_gru": op4_language_gru,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_rans_files": op8_rans_files,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_audit": op12_source_audit,
    "op13_source_mix": op13_source_mix,
}
