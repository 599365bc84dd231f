"""Joins that SQL has no word for: as of, first of a relation, band, grid and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import spatial


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row of its key that is not later, by one sort of the union."""
    both = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)}).unionByName(
        right.select(*key, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    order = Window.partitionBy(*key).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_t", "_v", "_side")


def first_related(left: DataFrame, relations: DataFrame, key: str, order: list[Column], value: str, name: str) -> DataFrame:
    """A left row with the first related value in an order: the lateral join with LIMIT 1, by aggregation before the join."""
    first = relations.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(name))
    return left.join(first, key, "left")


def prefix_match(designations: DataFrame, catalog: DataFrame, text: str, key: str) -> DataFrame:
    """Exact catalog key, else the only key that starts with `<text>x`; how says which."""
    exact = designations.join(catalog.select(F.col(key).alias(text), F.col(key).alias("matched")), text, "left")
    heads = catalog.select(F.col(key), F.explode(F.transform(F.sequence(F.lit(1), F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))).alias("head"))
    heads = heads.where(F.endswith("head", F.lit("x")))
    unique = heads.groupBy("head").agg(F.count("*").alias("n"), F.min(key).alias("only_key")).where("n = 1").select(F.expr("left(head, length(head) - 1)").alias(text), "only_key")
    out = exact.join(unique, text, "left")
    how = F.when(F.col("matched").isNotNull(), "exact").when(F.col("only_key").isNotNull(), "prefix").otherwise("none")
    return out.select(*designations.columns, F.coalesce("matched", "only_key").alias(key), how.alias("how"))


def placed(df: DataFrame, size: float, other: DataFrame, own: tuple[int, int], above: int) -> DataFrame:
    """A row for each cell of the box's own level, in the roles `own`, and of the levels above that the other side has, in the role `above`."""
    most = other.agg(F.max(spatial.level(spatial.box(), size)).alias("_most"))  # a row; null if the other side is empty
    at = lambda level: spatial.cells(spatial.box(), F.lit(size) * F.pow(F.lit(2.0), level))
    def places(role: int, level: Column) -> Column:
        return F.transform(at(level), lambda cell: F.struct(F.lit(role).alias("role"), level.alias("level"), cell.alias("cell")))

    first = F.concat(*[places(role, F.col("_level")) for role in own])
    ups = F.flatten(F.transform(F.sequence(F.col("_level") + 1, F.col("_most")), lambda up: places(above, up)))
    rows = df.withColumn("_level", spatial.level(spatial.box(), size)).join(F.broadcast(most)).where("_most is not null")
    every = F.when(F.col("_most") > F.col("_level"), F.concat(first, ups)).otherwise(first)
    return rows.withColumn("_place", F.explode(every)).drop("_level", "_most")


def overlapping(a: DataFrame, b: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose boxes overlap, and that agree in the columns `by`: an equi-join of grid cells.

    A box lies in the grid of its level, by its own extent, so none touches more than four cells however large it is.
    Two boxes meet in the grid of the larger one, in the role of equals (0), a above (1) or b above (2); each pair once,
    in the cell of its first corner. a has id and the box columns, b the same; the result has those of b with the prefix
    `b_`.
    """
    there = placed(b, size, a, (0, 2), 1)
    there = there.select(*[F.col(c).alias(c if c in ("_place", *by) else f"b_{c}") for c in there.columns])
    both = placed(a, size, b, (0, 1), 2).join(there, [*by, "_place"])
    x, y = spatial.box(), spatial.box("b_")
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("_place.level"))
    first = (F.col("_place.cell.cx") == F.floor(F.greatest(x[0], y[0]) / width)) & (F.col("_place.cell.cy") == F.floor(F.greatest(x[1], y[1]) / width))
    return both.where(first & spatial.overlaps(x, y)).drop("_place")


def within(a: DataFrame, b: DataFrame, distance: float, size: float) -> DataFrame:
    """Pairs of rows whose boxes are at most a distance apart, with the distance."""
    grown = a.withColumns({"_x1": F.col("min_x"), "_y1": F.col("min_y"), "_x2": F.col("max_x"), "_y2": F.col("max_y"), "min_x": F.col("min_x") - distance, "min_y": F.col("min_y") - distance, "max_x": F.col("max_x") + distance, "max_y": F.col("max_y") + distance})
    pairs = overlapping(grown, b, size)
    own = [F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")]
    pairs = pairs.withColumn("distance", spatial.box_distance(own, spatial.box("b_"))).where(F.col("distance") <= distance)
    return pairs.drop("min_x", "min_y", "max_x", "max_y").withColumnsRenamed({"_x1": "min_x", "_y1": "min_y", "_x2": "max_x", "_y2": "max_y"})


BOX = ("min_x", "min_y", "max_x", "max_y")


def distinct_boxes(rows: DataFrame) -> DataFrame:
    """Each box once: the least id that has it, and how many rows have it (copies)."""
    return rows.groupBy(*BOX).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def best_of(rows: DataFrame, pairs: DataFrame, best: Column) -> DataFrame:
    """id, m: the least of a value over the pairs of a row's box.

    pairs come from distinct_boxes() of both sides, so that copies of boxes meet once, not each with each. Of equal hosts
    the least id is preferred, which is the one that distinct_boxes() keeps.
    """
    found = pairs.groupBy(*BOX).agg(F.min(best).alias("m"))
    return rows.select("id", *BOX).join(found, [*BOX]).groupBy("id").agg(F.min("m").alias("m"))


def nearest(a: DataFrame, b: DataFrame, distance: float, size: float) -> DataFrame:
    """id, host, distance of the nearest b within a distance; ties to the smaller id."""
    pairs = within(distinct_boxes(a), distinct_boxes(b), distance, size)
    return best_of(a, pairs, F.struct("distance", F.col("b_id").alias("host"))).select("id", "m.host", "m.distance")


def mutual_nearest(a: DataFrame, b: DataFrame, distance: float, size: float) -> DataFrame:
    """Pairs that are each other's nearest."""
    there = nearest(a, b, distance, size)
    back = nearest(b, a, distance, size).select(F.col("id").alias("host"), F.col("host").alias("back"))
    return there.join(back, "host").where("back = id").select("id", "host", "distance")


def smallest_container(points: DataFrame, frames: DataFrame, size: float) -> DataFrame:
    """id, host: the smallest frame that contains a row's centre; ties to the smaller id."""
    x, y = spatial.centre(spatial.box())
    centred = points.select("id", x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y"))
    pairs = overlapping(distinct_boxes(centred), distinct_boxes(frames), size)
    return best_of(centred, pairs, F.struct(spatial.area(spatial.box("b_")).alias("area"), F.col("b_id").alias("host"))).select("id", "m.host", "m.area")


def best_overlap(a: DataFrame, b: DataFrame, least: float, size: float) -> DataFrame:
    """id, host, iou of the best overlap of at least `least`; ties to the smaller id."""
    pairs = overlapping(distinct_boxes(a), distinct_boxes(b), size).withColumn("iou", spatial.iou(spatial.box(), spatial.box("b_"))).where(F.col("iou") >= least)
    best = best_of(a, pairs, F.struct((-F.col("iou")).alias("worse"), F.col("b_id").alias("host")))
    return best.select("id", "m.host", (-F.col("m.worse")).alias("iou"))


def only_container(points: DataFrame, frames: DataFrame, size: float) -> DataFrame:
    """id, host for rows whose centre lies in exactly one frame."""
    x, y = spatial.centre(spatial.box())
    centred = points.select("id", x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y"))
    pairs = overlapping(distinct_boxes(centred), distinct_boxes(frames), size)
    found = pairs.groupBy(*BOX).agg(F.sum("b_copies").alias("n"), F.min("b_id").alias("host"))
    return centred.join(found, [*BOX]).groupBy("id").agg(F.sum("n").alias("n"), F.min("host").alias("host")).where("n = 1").select("id", "host")


def dangling(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    return edges.join(nodes.select(F.col(key).alias(column)), column, "left_anti")


def resolved(relations: DataFrame, nodes: DataFrame, subject: str, target: str, key: str) -> DataFrame:
    """Relations both ends of which exist."""
    ids = nodes.select(key).distinct()
    return relations.join(ids.withColumnRenamed(key, subject), subject, "left_semi").join(ids.withColumnRenamed(key, target), target, "left_semi")


def ladder(left: DataFrame, steps: list[tuple[str, DataFrame, list[str], str]], name: str) -> DataFrame:
    """The value of the first step that has one: (step name, table, keys, value column) in order, and the step's name."""
    out = left
    for k, (_, right, keys, value) in enumerate(steps):
        out = out.join(right.select(*keys, F.col(value).alias(f"_v{k}")).dropDuplicates(keys), keys, "left")
    source = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(s[0])) for k, s in enumerate(steps)], F.lit("(none)"))
    return out.withColumns({name: F.coalesce(*[F.col(f"_v{k}") for k in range(len(steps))]), f"{name}_source": source}).drop(*[f"_v{k}" for k in range(len(steps))])
