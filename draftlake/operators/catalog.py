"""The element catalog: filters, counts and histograms over objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import spatial, text


@dataclass
class ElementFilter:
    kind: str | None = None
    project: str | None = None
    document: object | None = None
    layer: str | None = None
    block: str | None = None
    contains: str | None = None
    state: str | None = None
    storey: str | None = None
    window: tuple[float, float, float, float] | None = None

    def condition(self) -> Column:
        """One conjunction, so that equalities reach the scan."""
        own = F.lit(True)
        for column, value in (("kind", self.kind), ("project_id", self.project), ("document_id", self.document), ("state", self.state), ("storey", self.storey)):
            if value is not None:
                own &= F.col(column) == F.lit(value)
        if self.layer is not None:
            own &= text.wildcard(F.col("layer"), self.layer)
        if self.block is not None:
            own &= text.wildcard(F.col("block"), self.block)
        if self.contains is not None:
            own &= F.ilike(F.col("label"), F.lit(f"%{self.contains}%"))  # % and _ stay wildcards here
        if self.window is not None:
            own &= spatial.overlaps(spatial.box(), [F.lit(float(v)) for v in self.window])
        return own


def find(objects: DataFrame, what: ElementFilter, after: object | None = None, size: int = 100) -> DataFrame:
    from draftlake.operators.ranking import keyset_page

    return keyset_page(objects.where(what.condition()), "id", after, size)


def in_category(objects: DataFrame, documents: DataFrame, category: str) -> DataFrame:
    """Objects of a category by their own, by a view of their layout, or by their document: semi joins, one union of ids."""
    own = objects.where(F.col("category") == category).select("id")
    views = objects.where((F.col("kind") == "View") & (F.col("category") == category)).select("document_id", "layout").distinct()
    sheets = documents.where(F.col("category") == category).select("document_id")
    by_view = objects.join(views, ["document_id", "layout"], "left_semi").select("id")
    by_sheet = objects.join(sheets, "document_id", "left_semi").select("id")
    return objects.join(own.union(by_view).union(by_sheet).distinct(), "id", "left_semi")


def kinds(objects: DataFrame) -> DataFrame:
    return objects.groupBy("kind").agg(F.count("*").alias("objects"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("state") == "AI_INFERRED").alias("inferred"))


def category_rollup(objects: DataFrame) -> DataFrame:
    """Counts by category and kind, rolled up to the category: objects add up, documents take the largest."""
    each = objects.groupBy("category", "kind").agg(F.count("*").alias("objects"), F.countDistinct("document_id").alias("documents"))
    return each.groupBy("category").agg(F.sum("objects").alias("objects"), F.max("documents").alias("documents"), F.count("*").alias("kinds"))


def projects(objects: DataFrame) -> DataFrame:
    return objects.groupBy("project_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("objects"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n"))


def layer_kinds(objects: DataFrame, most: int = 200) -> DataFrame:
    """Layers by size with a map of their kinds' counts."""
    each = objects.groupBy("layer", "kind").agg(F.count("*").alias("n"))
    out = each.groupBy("layer").agg(F.sum("n").alias("objects"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    return out.orderBy(F.desc("objects"), "layer").limit(most)


def block_totals(objects: DataFrame) -> DataFrame:
    insert = F.col("block").isNotNull()
    return objects.agg(
        F.count_if(insert).alias("inserts"),
        F.countDistinct(F.when(insert, F.col("block"))).alias("blocks"),
        F.countDistinct(F.when(insert, F.col("document_id"))).alias("documents"),
        F.count_if(insert & (F.col("state") == "OBSERVED")).alias("observed"),
    )


def block_instances(objects: DataFrame) -> DataFrame:
    """Per block: inserts, documents, layers, and the kind that most of them have."""
    own = objects.where("block is not null")
    each = own.groupBy("block", "kind").agg(F.count("*").alias("n"), F.collect_set("layer").alias("layers"))
    out = each.groupBy("block").agg(
        F.sum("n").alias("inserts"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))), ",").alias("layers"),
        F.max_by("kind", F.struct("n", "kind")).alias("main_kind"),
    )
    documents = own.select("block", "document_id").distinct().groupBy("block").agg(F.count("*").cast("int").alias("documents"))
    return out.join(documents, "block").select("block", "inserts", "documents", "layers", "main_kind")


def sheet_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("document_id", "layout", "kind").agg(F.count("*").alias("n"))


def element_groups(objects: DataFrame, most: int = 20) -> DataFrame:
    """Per document and kind: objects, observed ones, the first ids, of which no more than `most` are gathered."""
    by = ["document_id", "kind"]
    sizes = objects.groupBy(*by).agg(F.count("*").alias("objects"), F.count_if(F.col("state") == "OBSERVED").alias("observed"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    first = objects.select(*by, "id").withColumn("nth", nth).where(F.col("nth") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("evidence"))
    return sizes.join(first, by)


def vote(layers: DataFrame) -> DataFrame:
    """Discipline of a drawing by its layers' votes: five at least, confidence min(0.8, 0.5 + 0.3 share of the winner)."""
    each = layers.groupBy("document_id", "discipline").agg(F.sum("votes").alias("votes"))
    out = each.groupBy("document_id").agg(F.max_by("discipline", F.struct("votes", "discipline")).alias("discipline"), F.max("votes").alias("top"), F.sum("votes").alias("total"))
    return out.where("total >= 5").select("document_id", "discipline", F.least(F.lit(0.8), 0.5 + 0.3 * F.col("top") / F.col("total")).alias("confidence"))


def names_overview(objects: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """Names over all drawings: drawings, entities, entities by drawing."""
    each = objects.groupBy(name, "document_id").agg(F.count("*").alias("n"))
    out = each.groupBy(name).agg(F.count("*").alias("drawings"), F.sum("n").alias("entities"), F.max("n").alias("most_in_one"))
    return out.orderBy(F.desc("entities"), name).limit(most)
