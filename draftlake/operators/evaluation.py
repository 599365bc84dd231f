"""Evaluation of retrieval and of answers, per case and in summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, expected: DataFrame, allowed: DataFrame, current: DataFrame, k: int) -> DataFrame:
    """Per case: hits among the first k, recall, reciprocal rank, unauthorised and stale hits, duplicates, coverage.

    hits: case_id, rank, canonical_id, source_id, revision_id, external_id, provenance; expected: canonical_id, allowed:
    source_id and current: source_id, revision_id, each with case_id if they differ by case.
    """
    top = hits.where(F.col("rank") <= k)
    by = lambda df, *keys: [c for c in ("case_id",) if c in df.columns] + list(keys)
    own = top.join(expected.withColumn("wanted", F.lit(True)), by(expected, "canonical_id"), "left")
    own = own.join(allowed.withColumn("open", F.lit(True)), by(allowed, "source_id"), "left")
    own = own.join(current.withColumn("fresh", F.lit(True)), by(current, "source_id", "revision_id"), "left")
    again = F.row_number().over(Window.partitionBy("case_id", "external_id").orderBy("rank")) > 1
    own = own.withColumn("again", again & F.col("external_id").isNotNull())
    each = own.groupBy("case_id").agg(
        F.count("*").alias("hits"), F.count_distinct(F.when(F.col("wanted"), F.col("canonical_id"))).alias("found"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first"),
        F.count_if(F.col("open").isNull()).alias("unauthorized"), F.count_if(F.col("fresh").isNull()).alias("stale"), F.count_if("again").alias("duplicates"), F.count_if("provenance").alias("covered"),
    )
    if "case_id" in expected.columns:
        each = each.join(expected.groupBy("case_id").agg(F.count("*").alias("expected")), "case_id")
    else:
        each = each.join(F.broadcast(expected.agg(F.count("*").alias("expected"))))  # one row
    return each.select("case_id", "hits", (F.col("found") / F.col("expected")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "unauthorized", "stale", "duplicates", (F.col("covered") / F.col("hits")).alias("coverage"))


def share(part: Column, whole: Column) -> Column:
    return F.round(F.count_if(part) / F.greatest(F.lit(1), F.count_if(whole)), 3)


def rag_summary(rows: DataFrame, by: str) -> DataFrame:
    """Per kind of question (answerable, hit, route, route_expected, refused, citations, citations_valid): rates to 3 digits."""
    able, cited = F.col("answerable"), F.col("citations") > 0
    return rows.groupBy(by).agg(
        F.count("*").alias("questions"),
        F.count_if(able).alias("answerable"),
        share(able & F.col("hit"), able).alias("recall"),
        share(able & (F.col("route") == F.col("route_expected")), able & F.col("route_expected").isNotNull()).alias("route_accuracy"),
        F.round(F.sum("citations_valid") / F.greatest(F.lit(1), F.sum("citations")), 3).alias("citation_validity"),
        share(~able & F.col("refused"), ~able).alias("refusal_accuracy"),
        F.count_if(able & F.col("refused")).alias("false_refusals"),
        share(able & cited & ~F.col("refused"), able).alias("answered_with_citation"),
    )
