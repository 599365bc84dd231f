"""Ranking, paging, percentiles and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order; end the order with a unique key."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: DISTINCT ON."""
    return top_per_group(df, keys, order, 1, "_nth").drop("_nth")


def keyset_page(df: DataFrame, key: str, after: object | None, size: int, most: int = 500) -> DataFrame:
    """Rows after a cursor in key order, one more than the page so that a reader sees whether another page follows."""
    size = max(1, min(most, size))
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size + 1)


def cursor(key: Column) -> Column:
    return F.base64(F.encode(F.to_json(F.struct(key.alias("id"))), "UTF-8"))


def at_rank(rows: DataFrame, by: str, value: str, rank: Callable[[Column], Column], cuts: int = 64) -> DataFrame:
    """by, n, value at the given rank (from 1, an expression of n) of each group's sorted values.

    Equal values count as one row with a weight; approximate quantiles cut a group into bins, and only the bin that
    holds the rank is sorted, so no task gathers a group.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("w"))
    edges = each.groupBy(by).agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 10_000).alias("edges"), F.sum("w").alias("n"))
    binned = each.join(edges, by).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    sizes = binned.groupBy(by, "bin").agg(F.sum("w").alias("size"), F.first("n").alias("n"))
    upto = F.sum("size").over(Window.partitionBy(by).orderBy("bin"))  # `cuts` rows a group
    wanted = sizes.withColumns({"upto": upto, "rank": rank(F.col("n"))}).where("rank <= upto and rank > upto - size").select(by, "bin", (F.col("rank") - F.col("upto") + F.col("size")).alias("rank"))
    inside = binned.join(wanted, [by, "bin"]).withColumn("upto", F.sum("w").over(Window.partitionBy(by).orderBy(value)))
    return inside.where("rank <= upto and rank > upto - w").select(by, "n", value)


def percentile_round(q: float) -> Callable[[Column], Column]:
    """Rank of sorted[round(q (n - 1))] with ties to even."""
    return lambda n: (F.bround(F.lit(q) * (n - 1), 0) + 1).cast("long")


def percentile_ceil(q: float) -> Callable[[Column], Column]:
    """Rank of sorted[ceil(q n) - 1]."""
    return lambda n: F.greatest(F.ceil(F.lit(q) * n), F.lit(1)).cast("long")


def fused(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank): the best rank of a key in each counts once."""
    each = [r.groupBy(key).agg(F.min("rank").alias("rank")) for r in rankings]
    union = each[0]
    for r in each[1:]:
        union = union.unionByName(r)
    return union.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def first_hit(ranked: DataFrame, case: str, hit: Column) -> DataFrame:
    """Rank of the first relevant row of each case, null if there is none."""
    return ranked.groupBy(case).agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))


def hit_rates(first: DataFrame, at: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """hit@k and mean reciprocal rank over cases."""
    shares = [F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in at]
    return first.groupBy(*(by or [])).agg(F.count("*").alias("cases"), *shares, F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def recall_at(hits: DataFrame, gold: DataFrame, case: str, item: str, k: int) -> DataFrame:
    """Share of each case's gold items among its first k hits."""
    found = hits.where(F.col("rank") <= k).select(case, item).distinct().join(gold, [case, item], "left_semi").groupBy(case).agg(F.count("*").alias("found"))
    return gold.groupBy(case).agg(F.count("*").alias("wanted")).join(found, case, "left").select(case, (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"))


def precision_recall(pairs: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per class precision, recall and F1; a row without a prediction is only a miss."""
    right = F.col(expected) == F.col(predicted)
    rows = pairs.select(F.explode(F.array(
        F.struct(F.col(expected).alias("label"), right.alias("tp"), F.lit(False).alias("fp"), (~F.coalesce(right, F.lit(False))).alias("fn")),
        F.struct(F.when(~right, F.col(predicted)).alias("label"), F.lit(False).alias("tp"), F.lit(True).alias("fp"), F.lit(False).alias("fn")),
    )).alias("x")).select("x.*").where("label is not null")
    sums = rows.groupBy("label").agg(*[F.sum(F.when(F.coalesce(F.col(c), F.lit(False)), 1).otherwise(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def seeded_sample(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """k rows in an order that depends on key and seed alone."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)
