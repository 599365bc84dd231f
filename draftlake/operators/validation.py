"""Validation: lists of problems, coverage scores, evidence states, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def subject_reference(source_hash: Column, revision: Column, locator: Column) -> Column:
    """Revision trio: all or none, and only with a 64-digit hash."""
    parts = F.array_compact(F.array(source_hash, revision.cast("string"), locator))
    return problems({"trio": F.size(parts).isin(0, 3), "hash": source_hash.isNull() | source_hash.rlike("^[0-9a-f]{64}$")})


def demoted(outcome: Column, problems_: Column, stale: Column) -> Column:
    """A rule's outcome goes to REVIEW if its authority has problems or its subject is stale."""
    return F.when(outcome.isin("PASS", "FAIL") & ((F.size(problems_) > 0) | stale), "REVIEW").otherwise(outcome)


def ingest_scores(objects: DataFrame) -> DataFrame:
    """One row: coverage ratios of classification, provenance, geometry and layers, their mean and a status."""
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    own = objects.agg(share(F.col("kind").isNotNull()).alias("classified"), share(F.col("document_id").isNotNull()).alias("provenance"), share(F.col("min_x").isNotNull()).alias("geometry"), share(F.col("layer").isNotNull()).alias("layered"))
    mean = (F.col("classified") + F.col("provenance") + F.col("geometry") + F.col("layered")) / 4
    return own.withColumn("score", mean).withColumn("status", F.when(mean >= 0.9, "PASS").when(mean >= 0.7, "WARN").otherwise("FAIL"))


def dashboard(objects: DataFrame, confidence: Column) -> DataFrame:
    return objects.agg(F.count("*").alias("objects"), F.countDistinct("document_id").alias("documents"), F.avg(F.coalesce(confidence, F.lit(0.0))).alias("confidence"))


def active(evidence: DataFrame) -> DataFrame:
    """Evidence (id, supersedes[]) that no other supersedes."""
    gone = evidence.select(F.explode("supersedes").alias("id")).distinct()
    return evidence.join(gone, "id", "left_anti")


def capability_state(evidence: DataFrame) -> DataFrame:
    """Per capability: its latest evidence of each kind, conflicts of equal time, and a summary state."""
    w = Window.partitionBy("capability", "kind")
    last = evidence.withColumn("last", F.max("observed").over(w)).where("observed = last")
    kinds = last.groupBy("capability", "kind").agg(F.max("outcome").alias("outcome"), F.countDistinct("outcome").alias("outcomes"))
    rank = F.when(F.max("outcomes") > 1, "CONFLICTED").when(F.count_if(F.col("outcome") == "FAIL") > 0, "FAILED").when(F.count_if(F.col("outcome") == "PASS") > 0, "SUPPORTED").otherwise("UNKNOWN")
    return kinds.groupBy("capability").agg(rank.alias("state"), F.count("*").alias("kinds"))


def freshness(revoked: Column, valid_to: Column, observed: Column, now: Column) -> Column:
    return F.when(revoked, "REVOKED").when(valid_to < now, "STALE").when(observed > now, "FUTURE").otherwise("CURRENT")


def license_state(declared: Column) -> Column:
    """State of an aggregated set of declarations."""
    n = F.countDistinct(declared)
    return F.when(n > 1, "CONFLICTED").when(n == 0, "UNKNOWN").otherwise("CONFIRMED")


def compare_inventory(expected: DataFrame, remote: DataFrame, key: str, digest: str) -> DataFrame:
    """Expected against remote ids and digests: missing, unexpected, changed, same."""
    a, b = expected.select(key, F.col(digest).alias("x")), remote.select(key, F.col(digest).alias("y"))
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
