"""A corpus pipeline of five operators: quality, language, line dedup, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's docs. All stages but the last return the columns of documents; other columns are left
behind. An empty table stays empty in every stage, repeated rows are judged alike, texts of any length are read whole,
and a row without a doc_id goes through every stage like the others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.llm import language, line_dedup, ngram_join, packing, quality
from draftlake.llm.common import shared_table, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BESIDE = ["doc_id", "lang", "source", "n_chars"]


def rejoined(df: DataFrame) -> DataFrame:
    return df.select("kept.doc_id", "text", "kept.lang", "kept.source", "kept.n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier predicts as good; null and empty texts are rejected (score 0).

    Without labels of both kinds nothing is learned, every text scores one half and stays.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return rejoined(quality.score(docs, model, keep=BESIDE).where("predicted = 1"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known: not `und`, and at least half of the posterior.

    Null texts and texts without letters are `und` and go. Languages of equal code length: the first by name.
    """
    model = language.train(docs)
    return rejoined(language.identify(docs, model, keep=BESIDE).where("lang_pred != 'und' and score >= 0.5"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated runs of lines; a document of which nothing but white space is left goes.

    A null text, or one that was blank before, stays. Of equal runs the one in the smallest (doc_id, line) stays; a null
    doc_id counts as smallest.
    """
    out = line_dedup.dedup(docs.select(*COLUMNS))
    out = out.where(F.col("text").isNull() | (F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one whose doc_id names the group, once.

    Rows with a null doc_id stay, once for each text; null and empty texts are groups of their own.
    """
    groups = ngram_join.join(docs).where("doc_id is not null and doc_id = component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(groups, "doc_id", "left_semi").unionByName(docs.select(*COLUMNS).where("doc_id is null"))
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    return kept.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null or empty text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]
#: No SQL expresses the learned stages; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, name.replace(" ", "-"))
    return docs
