"""Portable tables and their manifest, projections into stores, packs, memory packages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import identity, text
from draftlake.operators import tables

STATES = ("OBSERVED", "USER_CONFIRMED", "CALCULATED")


def classifications(objects: DataFrame) -> DataFrame:
    return objects.where("classification is not null").select(F.col("id").alias("object_id"), "classification.*")


def provenance(objects: DataFrame) -> DataFrame:
    return objects.where("provenance is not null").select(F.col("id").alias("object_id"), "provenance.*")


def source_mappings(objects: DataFrame) -> DataFrame:
    return objects.select(F.col("id").alias("global_object_id"), "project_id", F.col("source.file").alias("source_file"), F.col("source.entity_id").alias("source_entity_id"))


def geometry_index(geometry: DataFrame) -> DataFrame:
    """Reference from the first of handle, entity id, source id, feature id; CRS `local` if unknown."""
    ref = F.coalesce("handle", "source_entity_id", "source_id", "feature_id")
    return geometry.select(F.concat(F.lit("geom:"), ref).alias("geometry_ref"), ref.alias("source_entity_id"), F.coalesce("kind", F.lit("unknown")).alias("geometry_type"), F.coalesce("crs", F.lit("local")).alias("crs"))


def export(parts: dict[str, DataFrame], path: str) -> dict[str, int]:
    """JSON lines and Parquet of every table and a manifest of their rows, from what was written."""
    spark, rows = next(iter(parts.values())).sparkSession, {}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        written = spark.read.schema(df.schema).parquet(f"{path}/{name}.parquet")
        written.write.mode("overwrite").json(f"{path}/{name}.jsonl")
        rows[name] = written.count()
    body = json.dumps({"schema": "portable-tables/1", "rows": rows}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return rows


def project_documents(objects: DataFrame, relations: DataFrame, path: str) -> None:
    """Replace the objects and relations of exactly the documents that come: dynamic overwrite of their partitions."""
    tables.replace_partitions(objects, f"{path}/objects", ["document_id"])
    tables.replace_partitions(relations, f"{path}/relations", ["document_id"])


def graph_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations of a first-class state both ends of which exist."""
    from draftlake.operators.joins import resolved

    return resolved(relations.where(F.col("state").isin(*STATES)), nodes, "subject", "object", "id")


def write_graph(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, path: str) -> None:
    """Replace the graph of exactly the projects that come."""
    for name, df in (("nodes", nodes), ("edges", edges), ("aliases", aliases)):
        tables.replace_partitions(df, f"{path}/{name}", ["project_key"])


def pack_tables(nodes: DataFrame, edges: DataFrame, names: DataFrame, pack: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of a knowledge pack under its own project key; every node with a text is a finished community."""
    key = F.lit(f"kb:{pack}")
    search = F.substring(F.concat_ws(" ", "type", "name", "text"), 1, 2000)
    texts = nodes.where(F.coalesce("text", F.lit("")) != "")
    communities = texts.select(F.concat(F.lit("kc:"), "id").alias("id"), key.alias("project_key"), F.lit(1).alias("level"), F.col("name").alias("title"), F.col("text").alias("summary"), F.lit("DONE").alias("status"))
    return nodes.withColumns({"project_key": key, "search_text": search}), edges.withColumn("project_key", key), names.withColumn("project_key", key), communities


def pruned(stored: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Stored rows that the corpus still has."""
    return stored.join(corpus.select(key).distinct(), key, "left_semi")


def put_artifacts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New artifacts by (project, type, digest); what is stored already is not stored again."""
    keys = ["project_id", "artifact_type", "sha256"]
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def memory_package(objects: DataFrame, project: str) -> DataFrame:
    """Per project: type counts, tokens and a 64-dimensional vector of its labels."""
    from draftlake.functions.similarity import hash_vector

    own = objects.groupBy(F.col(project).alias("project")).agg(F.count("*").alias("objects"), F.array_join(F.array_sort(F.collect_set("kind")), " ").alias("kinds"))
    return own.select("project", "objects", "kinds", hash_vector(F.col("kinds")).alias("vector"))


def context_records(rows: DataFrame, revision: Column, external: Column, body: Column) -> DataFrame:
    return rows.select(F.concat(F.lit("ctx_"), identity.short_hash(revision, external, n=24)).alias("id"), external.alias("external_id"), F.coalesce(F.nullif(F.trim(body), F.lit("")), external).alias("text"))


def ontology(classes: DataFrame, properties: DataFrame, prefix: str = "dl") -> DataFrame:
    """Turtle lines of classes (name, parent) and properties (name, kind, domain) under a prefix."""
    c = classes.select(F.concat(F.lit(f"{prefix}:"), "name", F.lit(" a owl:Class"), F.coalesce(F.concat(F.lit(f" ; rdfs:subClassOf {prefix}:"), "parent"), F.lit("")), F.lit(" .")).alias("line"))
    p = properties.select(F.concat(F.lit(f"{prefix}:"), "name", F.lit(" a owl:"), "kind", F.lit(f" ; rdfs:domain {prefix}:"), "domain", F.lit(" .")).alias("line"))
    return c.unionByName(p)


def drawing_line(number: Column, title: Column, place: Column, date: Column) -> Column:
    """One line of facts about a drawing."""
    return F.concat_ws(" ", number, title, F.concat(F.lit("["), place, F.lit("]")), F.concat(F.lit("("), date, F.lit(")")))


def stem_links(documents: DataFrame, drawings: DataFrame) -> DataFrame:
    """Documents and drawings of one sub-project with equal normalised stems."""
    key = lambda c: F.lower(F.regexp_replace(text.stem(c), r"[\s_\-.]+", ""))
    a = documents.select("project", F.col("id").alias("document"), key(F.col("name")).alias("key"))
    b = drawings.select("project", F.col("id").alias("drawing"), key(F.col("name")).alias("key"))
    return a.join(b, ["project", "key"]).select("document", "drawing")
