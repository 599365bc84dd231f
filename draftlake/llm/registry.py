"""Queries over the driver's tables, one for each operator, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm import fingerprints, language, licenses, line_dedup, mpeg_audio, nearest, ngram_join, quality, variants
from draftlake.llm.alignment import align
from draftlake.llm.common import table
from draftlake.llm.encode_decode import encode_and_decode
from draftlake.llm.packing import pack
from draftlake.llm.token_counts import count_tokens


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_columns(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited(table(spark, sf_dir, "documents"))
    digest, texts = F.sha2(F.encode("edited_text", "UTF-8"), 256), (fingerprints.text_of(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint"))
    return out.select("doc_id", "n_chars", digest.alias("edited_sha256"), *texts, "near_edited", "near_next")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words_of(table(spark, sf_dir, "documents")))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_media_columns,
        op4_quality_classifier,
        op5_language_id,
        op6_license_scan,
        op7_token_counts,
        op8_bpe_encode_decode,
        op9_line_dedup,
        op10_approximate_nearest_neighbours,
        op11_document_fingerprints,
        op12_spelling_variants,
        op13_cross_tokenizer_alignment,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.oracle(), "op12_spelling_variants": variants.oracle()}
