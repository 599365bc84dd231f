"""Nested blocks: the closure of the graph of inserts, with composed transforms and multiplied counts.

Every step is an equi-join of what has been placed with the inserts of its blocks. A block inside itself, over however
many others, is cut where it comes again, and nesting ends at a depth, so the steps are few whatever the tables hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators.tables import shared

#: Levels of nesting that are followed; a fixed value.
DEPTH = 8


def matrix(x: Column, y: Column, sx: Column, sy: Column, rotation: Column) -> Column:
    """The affine map of an insert: scaled, turned by degrees, moved; struct a, b, c, d, e, f of x' = ax + cy + e, y' = bx + dy + f."""
    turn = F.radians(rotation)
    parts = {"a": sx * F.cos(turn), "b": sx * F.sin(turn), "c": -sy * F.sin(turn), "d": sy * F.cos(turn), "e": x, "f": y}
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()])


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def composed(outer: Column, inner: Column) -> Column:
    """The map that first does `inner`."""
    e, f = apply(outer, inner["e"], inner["f"])
    parts = {"a": outer["a"] * inner["a"] + outer["c"] * inner["b"], "b": outer["b"] * inner["a"] + outer["d"] * inner["b"], "c": outer["a"] * inner["c"] + outer["c"] * inner["d"], "d": outer["b"] * inner["c"] + outer["d"] * inner["d"], "e": e, "f": f}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def inserts_of(rows: DataFrame) -> DataFrame:
    """document, id, owner, block, m from inserts with x, y, sx, sy, rotation: missing scales are 1, missing angles 0; owner is null in model space."""
    one = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    return rows.where(F.col("block").isNotNull()).select("document", "id", "owner", "block", matrix(one("x", 0.0), one("y", 0.0), one("sx", 1.0), one("sy", 1.0), one("rotation", 0.0)).alias("m"))


def placements(inserts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """document, root, block, m, depth of every block that model space shows, nested ones too; m maps the block to the world.

    root is the insert of model space; repeated inserts place a block again. Inserts of blocks that nothing places do not
    count; an empty table gives none.
    """
    own = shared(inserts, "inserts")
    level = own.where(F.col("owner").isNull()).select("document", F.col("id").alias("root"), "block", "m", F.array("block").alias("path"))
    inner = own.where(F.col("owner").isNotNull()).select("document", F.col("owner").alias("block"), F.col("block").alias("next"), F.col("m").alias("n"))
    out = []
    for k in range(1, depth + 1):
        level = shared(level, "placed")
        out.append(level.withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        step = level.join(inner, ["document", "block"]).where(~F.array_contains("path", F.col("next")))
        level = step.select("document", "root", F.col("next").alias("block"), composed(F.col("m"), F.col("n")).alias("m"), F.array_append("path", F.col("next")).alias("path"))
    return reduce(DataFrame.unionByName, out).drop("path")


def texts_in_world(texts: DataFrame, inserts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """document, root, text, x, y, depth: texts (document, owner, text, x, y) of model space (root null, depth 0) and of every placed block."""
    free = texts.where(F.col("owner").isNull()).select("document", F.lit(None).cast(inserts.schema["id"].dataType).alias("root"), "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0).alias("depth"))
    held = texts.where(F.col("owner").isNotNull()).select("document", F.col("owner").alias("block"), "text", F.col("x").alias("tx"), F.col("y").alias("ty"))
    x, y = apply(F.col("m"), F.col("tx"), F.col("ty"))
    return free.unionByName(placements(inserts, depth).join(held, ["document", "block"]).select("document", "root", "text", x.alias("x"), y.alias("y"), "depth"))


def insert_counts(inserts: DataFrame, names: DataFrame, depth: int = DEPTH) -> DataFrame:
    """document, block, inserts, effective, deepest: how often a block is inserted, and how often model space shows it through all nestings.

    names (document, block, source) gives anonymous copies of dynamic blocks the name of their source, under which they
    count; it must name a block once. Counts are multiplied along the kinds of paths, not along their instances.
    """
    name = lambda df, column: df.join(names.select("document", F.col("block").alias(column), F.col("source").alias("_s")), ["document", column], "left").withColumn(column, F.coalesce("_s", column)).drop("_s")
    own = name(name(inserts.where(F.col("block").isNotNull()).select("document", "owner", "block"), "block"), "owner")
    own = shared(own.groupBy("document", "owner", "block").agg(F.count("*").alias("n")), "counts")
    level = own.where(F.col("owner").isNull()).select("document", "block", "n", F.array("block").alias("path"))
    inner = own.where(F.col("owner").isNotNull()).select("document", F.col("owner").alias("block"), F.col("block").alias("next"), F.col("n").alias("times"))
    out = []
    for k in range(1, depth + 1):
        level = shared(level, "paths")
        out.append(level.select("document", "block", "n", F.lit(k).alias("depth")))
        if level.isEmpty():
            break
        step = level.join(inner, ["document", "block"]).where(~F.array_contains("path", F.col("next")))
        level = step.select("document", F.col("next").alias("block"), (F.col("n") * F.col("times")).alias("n"), F.array_append("path", F.col("next")).alias("path"))
    shown = reduce(DataFrame.unionByName, out).groupBy("document", "block").agg(F.sum("n").alias("effective"), F.max("depth").alias("deepest"))
    direct = own.groupBy("document", "block").agg(F.sum("n").alias("inserts"))
    return direct.join(shown, ["document", "block"], "left").select("document", "block", "inserts", F.coalesce("effective", F.lit(0)).alias("effective"), "deepest")
