"""Tables in the shared folder, keyed overwrite, and portable tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="draftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/draftlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Delete and insert of whole keys: only the partitions that df has are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint behind a count; otherwise the planner's own choice."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def objects_table(objects: DataFrame) -> DataFrame:
    """Portable row: nested fields as JSON with sorted keys."""
    nested = [c for c, t in objects.dtypes if t.startswith(("struct", "array", "map"))]
    flat = [F.col(c) for c in objects.columns if c not in nested]
    return objects.select(*flat, *[F.to_json(F.col(c), {"ignoreNullFields": "false"}).alias(f"{c}_json") for c in sorted(nested)])


def properties_table(objects: DataFrame) -> DataFrame:
    """Entity, attribute, value rows of a map column `properties`."""
    return objects.select(F.col("id").alias("object_id"), F.explode("properties").alias("property_name", "value")).select("object_id", "property_name", F.to_json(F.struct("value")).alias("value_json"))


def relations_table(relations: DataFrame) -> DataFrame:
    """subject, predicate, object, confidence (1 where none is given) and the provenance (a struct) as JSON."""
    return relations.select("subject", "predicate", "object", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.to_json("provenance", {"ignoreNullFields": "false"}).alias("provenance_json"))


def application_mappings(objects: DataFrame, applications: tuple[str, ...] = ("FreeCAD", "Blender", "QGIS"), status: str = "REFERENCE_ONLY") -> DataFrame:
    """Objects for each application: an explode of a literal array, no join."""
    return objects.select(F.col("id").alias("object_id"), F.explode(F.array(*map(F.lit, applications))).alias("application"), F.lit(status).alias("status"))
