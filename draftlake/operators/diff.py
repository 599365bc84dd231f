"""Differences of snapshots, count maps and code trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshots(before: DataFrame, after: DataFrame, key: str, state: list[str]) -> DataFrame:
    """key, change: added, deleted, modified or unchanged, by a full outer join and a null-safe compare of the state."""
    a = before.select(F.col(key).alias("k"), F.struct(*state).alias("x"))
    b = after.select(F.col(key).alias("k"), F.struct(*state).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(~F.col("x").eqNullSafe(F.col("y")), "modified").otherwise("unchanged")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), change.alias("change"))


def facets(before: DataFrame, after: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """For rows on both sides, which facets (named groups of columns) changed."""
    a = before.select(key, *[F.struct(*c).alias(f"a_{k}") for k, c in kinds.items()])
    b = after.select(key, *[F.struct(*c).alias(f"b_{k}") for k, c in kinds.items()])
    return a.join(b, key).select(key, *[(~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))).alias(k) for k in kinds])


def counts(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """Type counts on both sides and their delta."""
    a, b = (x.groupBy(kind).agg(F.count("*").alias(n)) for x, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, kind, "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.select(kind, "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("delta"))


def map_difference(a: Column, b: Column) -> Column:
    """Keys whose counts differ, with both counts."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("a"), F.coalesce(y, F.lit(0)).alias("b"))), lambda k, v: v["a"] != v["b"])


def parity(primary: Column, secondary: Column, same_source: Column, complete: Column) -> Column:
    """Status of a second reader's census against the first's."""
    return (
        F.when(secondary.isNull(), "NOT_RUN").when(~same_source, "INCOMPARABLE").when(F.size(map_difference(primary, secondary)) > 0, "MISMATCH").when(~complete, "INCOMPLETE").otherwise("PARITY")
    )


def promotion(before: Column, after: Column, errors: Column) -> Column:
    """Gate of a design iteration: no errors and no metric worse."""
    return F.when(errors > 0, "BLOCKED").when(F.exists(F.map_values(F.map_zip_with(before, after, lambda k, x, y: F.coalesce(y < x, F.lit(False)))), lambda w: w), "REVIEW").otherwise("PROMOTE")
