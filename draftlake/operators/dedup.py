"""Exact duplicates, canonical representatives, and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, key: Column, path: str, size: Column) -> DataFrame:
    """Content groups of two or more: copies, redundant copies and bytes, first path."""
    out = df.groupBy(key.alias("content")).agg(F.count("*").alias("copies"), F.min(path).alias("canonical"), F.max(size).alias("bytes"))
    return out.where("copies > 1").select("content", "copies", (F.col("copies") - 1).alias("redundant"), ((F.col("copies") - 1) * F.col("bytes")).alias("redundant_bytes"), "canonical")


def plan(df: DataFrame, key: Column, path: str, modified: str) -> DataFrame:
    """One job for each content: canonical is the smallest path, the others its aliases, the newest time counts."""
    return df.groupBy(key.alias("content")).agg(F.min(path).alias("canonical"), (F.count("*") - 1).alias("aliases"), F.max(modified).alias("newest"))


def representatives(df: DataFrame, key: list[str], order: list[Column], path: str) -> DataFrame:
    """Each row's representative: the first of its group in the order."""
    return df.withColumn("representative", F.first(path).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def pending(objects: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return objects.join(done, keys, "left_anti")


def embed_plan(objects: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Texts to embed, once each: content hash, number of carriers; without those that are known."""
    own = objects.where((F.col(text) != "") & F.col(text).isNotNull()).withColumn("content_hash", F.sha2(text, 256))
    return own.groupBy("content_hash").agg(F.count("*").alias("carriers")).join(known, "content_hash", "left_anti")


def orphans(vectors: DataFrame, mappings: DataFrame, keys: list[str], old: Column) -> DataFrame:
    """Vectors that no mapping uses and that are old enough to go."""
    return vectors.where(old).join(mappings, keys, "left_anti")


def stale_models(rows: DataFrame, key: str, model: str) -> DataFrame:
    """Rows of other models where the target model has the same key."""
    target = rows.where(F.col("model") == model).select(key).distinct()
    return rows.where(F.col("model") != model).join(target, key, "left_semi")


def collisions(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that come from more than one source."""
    return rows.groupBy(key).agg(F.countDistinct(source).alias("sources"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("names")).where("sources > 1")


def capped_union(rows: DataFrame, key: str, items: str, most: int = 20) -> DataFrame:
    """First `most` distinct items of each key's lists, ascending; no more than these are gathered."""
    each = rows.select(key, F.explode(items).alias("item")).distinct()
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("item"))).where(F.col("nth") <= most)
    return each.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias(items))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows and the old ones that they do not replace: last writer wins."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Order-preserving dedup: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
