"""Readers: the driver's rows written as files of each format into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators import relations
from draftlake.operators.tables import shared_dir
from draftlake.plans.adapters import query
from draftlake.sources import files

STEM = r"name=([^/]+)"


def stored(df: DataFrame, name: str, body: Column) -> str:
    """One text file for each row, under a folder that names it; the path of them all.

    Files are dealt to many tasks, which put them in their place themselves: the driver does not rename one after another.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/draftlake/files-{uuid.uuid4().hex}"
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.select(F.col(name).cast("string").alias("name"), body.alias("value")).repartition(parts, "name")
    own.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(path)
    return path


def stored_lines(df: DataFrame, name: str, order: str, line: Column) -> str:
    """Lines in the order of a column in files under the folder of each name: parts of a folder follow one another, no row gathers lines."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/draftlake/files-{uuid.uuid4().hex}"
    own = df.select(F.col(name).cast("string").alias("name"), F.col(order).alias("k"), line.alias("value"))
    own.repartitionByRange("name", "k").sortWithinPartitions("name", "k").select("name", "value").write.partitionBy("name").text(path)
    return path


def owner(path: str = "path") -> Column:
    """The name under which a file was stored."""
    return F.regexp_extract(path, STEM, 1)


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines(df: DataFrame, by: str, order: str, line: Column, head: str = "", tail: str = "") -> tuple[DataFrame, str, Column]:
    """One body for each value of `by`: head, a line for each row in order, tail."""
    own = df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("v")))), lambda x: x["v"]), "\n").alias("body"))
    return own, by, F.concat(F.lit(head), F.col("body"), F.lit(tail))


@query("SC-01 SC-02", """SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(s_suppkey AS VARCHAR) AS handle, CASE WHEN s_suppkey % 2 = 0 THEN 'CIRCLE' ELSE 'LINE' END AS entity_type, 'A-' || s_suppkey % 3 AS layer,
 CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey - 5.0::DOUBLE ELSE s_suppkey::DOUBLE END AS min_x, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 5.0::DOUBLE ELSE s_suppkey + 7.5::DOUBLE END AS max_x, CASE WHEN s_suppkey % 5 = 0 THEN 'Paper' ELSE 'Model' END AS layout FROM supplier""")
def dxf_entities(t, spark):
    n = F.col("s_suppkey")
    head = text_of("0\n", F.when(n % 2 == 0, "CIRCLE").otherwise("LINE"), "\n5\n", n, "\n8\nA-", n % 3, "\n", F.when(n % 5 == 0, "67\n1\n").otherwise(""), "10\n", n, "\n20\n1\n")
    body = F.concat(head, F.when(n % 2 == 0, "40\n5").otherwise(text_of("11\n", n + 7.5, "\n21\n2")))
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", body, "0\nSECTION\n2\nENTITIES\n", "\n0\nENDSEC\n0\nEOF"))
    return files.dxf(spark, path, "*").select(owner().alias("file"), "handle", "entity_type", "layer", "min_x", "max_x", "layout")


@query("SC-03 X-22", """SELECT CAST(s_nationkey AS VARCHAR) AS file, 'B' || s_suppkey AS name, CAST(1 + s_suppkey % 3 AS BIGINT) AS entities, CASE WHEN s_suppkey % 3 = 2 THEN 'B' || s_suppkey + 1 ELSE '' END AS inserts FROM supplier""")
def dxf_block_definitions(t, spark):
    n = F.col("s_suppkey")
    inner = F.concat(F.lit("\n0\nLINE\n10\n0\n20\n0\n11\n1\n21\n1"), F.when(n % 3 > 0, "\n0\nCIRCLE\n10\n0\n20\n0\n40\n1").otherwise(""), F.when(n % 3 == 2, text_of("\n0\nINSERT\n2\nB", n + 1)).otherwise(""))
    body = F.concat(text_of("0\nBLOCK\n2\nB", n), inner, F.lit("\n0\nENDBLK"))
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", body, "0\nSECTION\n2\nBLOCKS\n", "\n0\nENDSEC\n0\nEOF"))
    return files.dxf_blocks(spark, path, "*").select(owner().alias("file"), "name", "entities", F.array_join("inserts", ",").alias("inserts"))


@query("SC-03 X-22", "SELECT CAST(s_nationkey AS VARCHAR) AS file, 'L' || s_suppkey AS name, CAST(s_suppkey % 9 - 1 AS INTEGER) AS color FROM supplier")
def dxf_layer_table(t, spark):
    n = F.col("s_suppkey")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("0\nLAYER\n2\nL", n, "\n62\n", n % 9 - 1), "0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n", "\n0\nENDTAB\n0\nENDSEC\n0\nEOF"))
    return files.dxf_layers(spark, path, "*").select(owner().alias("file"), "name", "color")


@query("P-26 P-27 X-24 S-04", "SELECT CAST(s_suppkey AS VARCHAR) AS handle, 'A-' || s_suppkey % 900 AS number, s_name AS title, CAST(4 AS INTEGER) AS points FROM supplier")
def dxf_attributes(t, spark):
    """Attributes after an insert and vertices after a polyline belong to it."""
    n = F.col("s_suppkey")
    insert = text_of("0\nINSERT\n5\n", n, "\n2\nTITLE\n10\n0\n20\n0\n0\nATTRIB\n2\nDWG_NO\n1\nA-", n % 900, "\n0\nATTRIB\n2\nTITLE\n1\n", F.col("s_name"), "\n0\nSEQEND\n0\nPOLYLINE\n5\n", n)
    corner = "".join(f"\n0\nVERTEX\n10\n{x}\n20\n{y}" for x, y in ((0, 0), (1, 0), (1, 1), (0, 1)))
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", F.concat(insert, F.lit(corner + "\n0\nSEQEND")), "0\nSECTION\n2\nENTITIES\n", "\n0\nENDSEC"))
    rows = files.dxf(spark, path, "*")
    inserts = rows.where("entity_type = 'INSERT'").select("handle", F.col("attributes")["DWG_NO"].alias("number"), F.col("attributes")["TITLE"].alias("title"))
    return inserts.join(rows.where("entity_type = 'POLYLINE'").select("handle", F.size("points").alias("points")), "handle")


@query("SC-06 P-12", "SELECT CAST(s_nationkey AS VARCHAR) AS file, s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'IFCWALL' ELSE 'IFCDOOR' END AS type, 'g' || s_suppkey AS global_id, 'it''s; ' || s_name AS name FROM supplier")
def ifc_entities(t, spark):
    """Names hold quotes and semicolons; every fiftieth entity has a description of a megabyte full of them."""
    n = F.col("s_suppkey")
    long = F.when(n % 50 == 0, text_of("'", F.repeat(F.lit("'';x"), F.lit(1 << 18)), "'")).otherwise("$")
    body = text_of("#", n, "=", F.when(n % 2 == 0, "IFCWALL").otherwise("IFCDOOR"), "('g", n, "',#5,'it''s; ", F.col("s_name"), "',", long, ",$);")
    own = t("supplier").select("s_nationkey", n.cast("long").alias("k"), body.alias("line"))
    rim = lambda k, line: t("supplier").select("s_nationkey").distinct().select("s_nationkey", F.lit(k).cast("long").alias("k"), F.lit(line).alias("line"))
    every = rim(-1 << 63, "ISO-10303-21;\nDATA;").unionByName(own).unionByName(rim((1 << 63) - 1, "ENDSEC;"))
    path = stored_lines(every, "s_nationkey", "k", F.col("line"))
    return files.ifc(spark, path).select(owner().alias("file"), "id", "type", "global_id", "name")


@query("SC-06 P-12", "SELECT s_nationkey + 1000000 AS subject, 'contains' AS predicate, s_suppkey AS object FROM supplier")
def ifc_containment(t, spark):
    own = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("#"), x.cast("string"))), ",").alias("body"))
    path = stored(own, "s_nationkey", text_of("#9=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',#5,$,$,(", F.col("body"), "),#", F.col("s_nationkey") + 1000000, ");"))
    return files.ifc_relations(files.ifc(spark, path)).select("subject", "predicate", "object")


@query("SC-07 P-13", "SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, 'Polygon' AS geometry_type, s_suppkey::DOUBLE AS min_x, 0.0::DOUBLE AS min_y, s_suppkey + 2.5::DOUBLE AS max_x, 4.0::DOUBLE AS max_y, s_name AS name, 'EPSG:5186' AS crs FROM supplier")
def geojson_features(t, spark):
    n = F.col("s_suppkey")
    ring = text_of("[[[", n, ",0],[", n + 2.5, ",0],[", n + 2.5, ",4],[", n, ",0]]]")
    one = text_of('{"type":"Feature","id":"', n, '","properties":{"name":"', F.col("s_name"), '"},"geometry":{"type":"Polygon","coordinates":', ring, "}}")
    own = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("body"))
    path = stored(own, "s_nationkey", text_of('{"type":"FeatureCollection","crs":{"properties":{"name":"EPSG:5186"}},"features":[', F.col("body"), "]}"))
    rows = files.geojson(spark, path)
    return rows.select("feature_id", "geometry_type", "min_x", "min_y", "max_x", "max_y", F.get_json_object("properties", "$.name").alias("name"), "crs")


@query("SC-12 SC-16", "SELECT CAST(s_nationkey AS VARCHAR) AS file, count(*) AS vertices, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS faces, CAST(1 AS BIGINT) AS groups, min(s_suppkey)::DOUBLE AS min_x, max(s_suppkey)::DOUBLE AS max_x, max(s_suppkey % 11)::DOUBLE AS max_z FROM supplier GROUP BY 1")
def obj_models(t, spark):
    n = F.col("s_suppkey")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", F.concat(text_of("v ", n, " 0.5 ", n % 11), F.when(n % 3 == 0, "\nf 1 1 1").otherwise("")), "# model\ng all\n"))
    return files.obj(spark, path).select(owner().alias("file"), "vertices", "faces", "groups", "min_x", "max_x", "max_z")


@query("SC-13", "SELECT CAST(s_nationkey AS VARCHAR) AS file, 'ascii' AS kind, count(*) AS facets, min(s_suppkey)::DOUBLE AS min_x, max(s_suppkey)::DOUBLE + 1 AS max_x FROM supplier GROUP BY 1")
def stl_models(t, spark):
    n = F.col("s_suppkey")
    body = text_of("facet normal 0 0 1\nouter loop\nvertex ", n, " 0 0\nvertex ", n + 1, " 0 0\nvertex ", n, " 1 0\nendloop\nendfacet")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", body, "solid x\n", "\nendsolid x"))
    return files.stl(spark, path, "*").select(owner().alias("file"), "kind", "facets", "min_x", "max_x")


@query("SC-14", "SELECT CAST(s_nationkey AS VARCHAR) AS file, '2.0' AS version, CAST(count(*) AS INTEGER) AS nodes, CAST(1 AS INTEGER) AS meshes, CAST(0 AS INTEGER) AS materials FROM supplier GROUP BY 1")
def gltf_models(t, spark):
    own = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.collect_list("s_suppkey"), lambda x: F.concat(F.lit('{"mesh":0,"name":"'), x.cast("string"), F.lit('"}'))), ",").alias("body"))
    path = stored(own, "s_nationkey", text_of('{"asset":{"version":"2.0"},"meshes":[{"primitives":[]}],"nodes":[', F.col("body"), "]}"))
    return files.gltf(spark, path, "*").select(owner().alias("file"), "version", "nodes", "meshes", "materials")


@query("SC-15 A-37", "SELECT CAST(s_nationkey AS VARCHAR) AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'CARTESIAN_POINT' ELSE 'DIRECTION' END AS type, count(*) AS n FROM supplier GROUP BY 1, 2")
def step_types(t, spark):
    n = F.col("s_suppkey")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("#", n, " = ", F.when(n % 2 == 0, "CARTESIAN_POINT").otherwise("DIRECTION"), "('',(0.,0.,1.));"), "DATA;\n"))
    return files.step_histogram(spark, path).select(owner().alias("file"), "type", "n")


@query("SC-17", """SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(count(*) AS INTEGER) AS width, 200000.0::DOUBLE AS min_x, 200000.0::DOUBLE + 2.5 * count(*) AS max_x, CAST(count(*) FILTER (WHERE s_suppkey % 4 > 0) AS INTEGER) AS cells,
 min(s_suppkey) FILTER (WHERE s_suppkey % 4 > 0)::DOUBLE AS least, max(s_suppkey) FILTER (WHERE s_suppkey % 4 > 0)::DOUBLE AS most FROM supplier GROUP BY 1""")
def ascii_grids(t, spark):
    n = F.col("s_suppkey")
    own = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_join(F.collect_list(F.when(n % 4 == 0, "-9999").otherwise(n.cast("string"))), " ").alias("body"))
    path = stored(own, "s_nationkey", text_of("ncols ", F.col("n"), "\nnrows 1\nxllcorner 200000\nyllcorner 0\ncellsize 2.5\nNODATA_value -9999\n", F.col("body")))
    return files.ascii_grid(spark, path).select(owner().alias("file"), "width", "min_x", "max_x", "cells", "least", "most")


@query("SC-09 A-37", "SELECT CAST(s_nationkey AS VARCHAR) AS file, '0 0 10 10' AS view_box, CASE WHEN s_suppkey % 2 = 0 THEN 'rect' ELSE 'path' END AS tag, count(*) AS n FROM supplier GROUP BY 1, 3")
def svg_elements(t, spark):
    n = F.col("s_suppkey")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", F.when(n % 2 == 0, '<svg:rect width="1"/>').otherwise("<path d='M0 0'/>"), "<svg viewBox='0 0 10 10'>\n", "\n</svg>"))
    return files.svg(spark, path).where("tag != 'svg'").select(owner().alias("file"), "view_box", "tag", "n")


@query("SC-10", "SELECT CAST(s_nationkey AS VARCHAR) AS file, '1.7' AS version, count(*) AS pages, 595.0::DOUBLE AS width FROM supplier GROUP BY 1")
def pdf_references(t, spark):
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of(F.col("s_suppkey"), " 0 obj << /Type /Page /MediaBox [0 0 595 842] >> endobj"), "%PDF-1.7\n1 0 obj << /Type /Pages >> endobj\n"))
    return files.pdf(spark, path, "*").select(owner().alias("file"), "version", F.col("pages").cast("long").alias("pages"), "width")


@query("SC-22 SC-23", "SELECT CAST(s_suppkey AS VARCHAR) AS file, length(s_name) + 7 AS size, sha256('AC1032' || s_name || chr(10)) AS sha256, '2018' AS release FROM supplier")
def file_census(t, spark):
    path = stored(t("supplier"), "s_suppkey", text_of("AC1032", F.col("s_name")))
    return files.census(spark, path).where("sha256 is not null and path like '%.txt'").select(owner().alias("file"), "size", "sha256", "release")


@query("SC-24 SC-25 SC-36 SC-31", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 <> 3")
def jsonl_torn_lines(t, spark):
    """Each tenth line is torn: it is left out alone."""
    n = F.col("o_orderkey")
    line = text_of('{"id":', n, ',"state":"', F.col("o_orderstatus"), '"}')
    own = t("orders").withColumn("name", n % 8)
    return files.jsonl(spark, stored_lines(own, "name", "o_orderkey", F.when(n % 10 == 3, F.substring(line, 1, 9)).otherwise(line)) + "/*", "id long, state string")


@query("SC-25 SC-28 W-08", "SELECT o_custkey AS id, arg_max(o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN 1 WHEN o_orderkey % 10 < 9 THEN 3 ELSE 2 END * 1000000000000 + o_orderkey) AS last FROM orders GROUP BY 1")
def last_registry_rows(t, spark):
    """The last record of a key by file and line, over files of unequal size that share their keys."""
    n = F.col("o_orderkey")
    own = t("orders").withColumn("name", F.when(n % 10 < 6, 1).when(n % 10 < 9, 3).otherwise(2))
    path = stored_lines(own, "name", "o_orderkey", text_of('{"id":', F.col("o_custkey"), ',"last":', n, "}"))
    return files.last_per_key(spark, path, "id long, last long", "id")


@query("SC-26", "SELECT 'p' || s_nationkey AS project_id, 'o' || s_suppkey AS id, 'Wall' AS type, s_name AS label, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END, 1.0::DOUBLE) AS confidence FROM supplier")
def snapshot_objects(t, spark):
    n = F.col("s_suppkey")
    one = text_of('{"id":"o', n, '","type":"Wall","classification":{"label":"', F.col("s_name"), '"}}')
    edge = text_of('{"subject":"o', n, '","predicate":"in","object":"p"', F.when(n % 2 == 0, ',"confidence":0.5').otherwise(""), "}")
    own = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(one), ",").alias("objects"), F.array_join(F.collect_list(edge), ",").alias("relations"))
    path = stored(own, "s_nationkey", text_of('{"project_id":"p', F.col("s_nationkey"), '","objects":[', F.col("objects"), '],"relations":[', F.col("relations"), "]}"))
    objects, rel = files.snapshot(spark, path + "/*")
    return objects.join(rel.select("project_id", F.col("subject").alias("id"), "confidence"), ["project_id", "id"]).select("project_id", "id", "type", F.col("classification.label").alias("label"), "confidence")


@query("SC-27 SC-28 J-14", "SELECT 'e' || s_suppkey AS src, 'n' || s_suppkey + 1 AS dst FROM supplier WHERE s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier)")
def knowledge_pack_dangling(t, spark):
    """A pack is read, and edges whose ends it lacks are reported."""
    n = F.col("s_suppkey")
    nodes = text_of('{"id":"e', n, '","type":"T"},{"id":"n', n, '","type":"T"}')
    edges = text_of('{"src":"e', n, '","predicate":"next","dst":"n', n + 1, '"}')
    own = t("supplier").groupBy(F.lit("pack").alias("name")).agg(F.array_join(F.collect_list(nodes), ",").alias("nodes"), F.array_join(F.collect_list(edges), ",").alias("edges"))
    path = stored(own, "name", text_of('{"schema":"pack/1","nodes":[', F.col("nodes"), '],"edges":[', F.col("edges"), '],"aliases":[]}'))
    nodes, edges, _ = files.knowledge_pack(spark, path + "/*")
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


@query("SC-32", "SELECT CAST(s_nationkey AS VARCHAR) AS file, 'S' || s_suppkey AS section, 'name' AS key, s_name AS value FROM supplier")
def ini_settings(t, spark):
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("[S", F.col("s_suppkey"), "]\n; note\nname = ", F.col("s_name")), "top=1\n"))
    return files.ini(spark, path).where("section is not null").select(owner().alias("file"), "section", "key", "value")


@query("SC-32", "SELECT CAST(s_nationkey AS VARCHAR) AS file, 'P' || s_suppkey AS name, s_name AS description, 2 AS definitions FROM supplier")
def hatch_patterns(t, spark):
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("*P", F.col("s_suppkey"), ", ", F.col("s_name"), "\n45,0,0,0,.125\n; no\n135,0,0,0,.125")))
    return files.patterns(spark, path).select(owner().alias("file"), "name", "description", "definitions")


@query("SC-32", "SELECT CAST(s_nationkey AS VARCHAR) AS file, 'C' || s_suppkey AS alias, 'CMD' || s_suppkey AS command FROM supplier")
def command_aliases(t, spark):
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("C", F.col("s_suppkey"), ",   *CMD", F.col("s_suppkey")), "; file\n"))
    return files.aliases(spark, path).select(owner().alias("file"), "alias", "command")


@query("SC-29", "SELECT 'H' || s_suppkey AS key, s_suppkey::DOUBLE AS first FROM supplier")
def section_catalog_rows(t, spark):
    """Tables of eleven fields; a key's first row counts, shorter rows are headings."""
    n = F.col("s_suppkey")
    row = text_of("H", n, " ", n, " 1 2 3 4 5 6 7 8 9\nH", n, " 0 1 2 3 4 5 6 7 8 9")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", row, "name h b\n"))
    return files.sections_catalog(spark, path + "/*").select("key", F.col("numbers")[0].alias("first"))


@query("SC-33", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(event_id AS VARCHAR) AS job, CASE WHEN event_type = 'view' THEN 'claim' ELSE 'done' END AS event FROM events WHERE event_type IN ('view', 'click')")
def worker_logs(t, spark):
    kind = F.col("event_type")
    line = text_of(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " worker ", F.when(kind == "view", "claim").when(kind == "click", "done").otherwise("idle"), " job=", F.col("event_id"))
    rows = files.worker_log(spark, stored_lines(t("events").withColumn("name", F.col("event_id") % 8), "name", "event_id", line) + "/*")
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "job", "event")


@query("SC-34", "SELECT CAST(s_suppkey AS VARCHAR) AS file, sha256(s_name || chr(10)) AS sha256, length(s_name) + 1 AS size FROM supplier")
def code_files(t, spark):
    path = stored(t("supplier"), "s_suppkey", F.col("s_name"))
    return files.code_tree(spark, path, ["txt"]).select(owner().alias("file"), "sha256", "size")


@query("SC-11 SC-16 SC-19", "SELECT CAST(s_nationkey AS VARCHAR) AS file, count(*) AS vertices FROM supplier GROUP BY 1")
def reader_dispatch(t, spark):
    """The reader is chosen by the extension of the path."""
    own, name, body = lines(t("supplier"), "s_nationkey", "s_suppkey", text_of("v ", F.col("s_suppkey"), " 0 0"))
    path = f"{shared_dir(spark).rstrip('/')}/draftlake/models-{uuid.uuid4().hex}.obj"
    own.select(F.col(name).cast("string").alias("name"), body.alias("value")).write.partitionBy("name").text(path)
    return files.read(spark, path).select(owner().alias("file"), "vertices")


@query("P-13 SC-07", """SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, CASE s_suppkey % 4 WHEN 0 THEN 'Building' WHEN 1 THEN 'Road' WHEN 2 THEN 'OpenSpace' ELSE 'GISFeature' END AS type, CASE WHEN s_suppkey % 4 = 3 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
 CASE WHEN s_suppkey % 4 = 3 THEN 'REQUIRES_REVIEW' ELSE 'ACCEPT_WITH_WARNING' END AS state, s_suppkey::DOUBLE AS min_x, s_suppkey::DOUBLE AS max_x FROM supplier""")
def gis_object_types(t, spark):
    """Objects of features by the first known property; other features stay generic and go to review."""
    n = F.col("s_suppkey")
    kind = F.when(n % 4 == 0, '"kind":"Building","landuse":"park"').when(n % 4 == 1, '"name":"x","category":"STREET"').when(n % 4 == 2, '"landuse":"park"').otherwise('"kind":"tunnel"')
    one = text_of('{"type":"Feature","id":"', n, '","properties":{', kind, '},"geometry":{"type":"Point","coordinates":[', n, ",1]}}")
    own = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(one), ",").alias("body"))
    rows = files.geojson(spark, stored(own, "s_nationkey", text_of('{"type":"FeatureCollection","features":[', F.col("body"), "]}")))
    return relations.gis_objects(rows).select("feature_id", "type", "confidence", "state", "min_x", "max_x")


@query("P-12 SC-06", """SELECT s_suppkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'Wall' WHEN 1 THEN 'Storey' ELSE 'IFCEntity' END AS type, CASE WHEN s_suppkey % 3 = 2 THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN s_suppkey % 3 = 2 THEN 'REQUIRES_REVIEW' ELSE 'AUTO_ACCEPT' END AS state, s_name AS name FROM supplier""")
def ifc_object_types(t, spark):
    """Objects of entities by their class, without the relations between them."""
    n = F.col("s_suppkey")
    kind = F.when(n % 3 == 0, "IFCWALLSTANDARDCASE").when(n % 3 == 1, "IFCBUILDINGSTOREY").otherwise("IFCFLOWSEGMENT")
    body = text_of("#", n, "=", kind, "('g", n, "',#5,'", F.col("s_name"), "',$);#", n + 1_000_000, "=IFCRELAGGREGATES('r", n, "',$,$,$,#", n, ",(#1));")
    path = stored(*lines(t("supplier"), "s_nationkey", "s_suppkey", body, "ISO-10303-21;\nDATA;\n", "\nENDSEC;"))
    return relations.ifc_objects(files.ifc(spark, path), "P").select("entity_id", "type", "confidence", "state", "name")


@query("P-26 P-27 X-24 S-04", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN 'A-' || s_suppkey END AS number, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 > 0 THEN '1:100' END AS scale FROM supplier
 WHERE CAST(s_suppkey % 3 > 0 AS INTEGER) + CAST(s_suppkey % 2 = 0 AS INTEGER) + CAST(s_suppkey % 5 > 0 AS INTEGER) >= 2 AND (s_suppkey % 3 > 0 OR s_suppkey % 2 = 0)""")
def title_block_fields(t, spark):
    """Attributes of inserts as the fields of title blocks: two known ones at least, a number or title among them."""
    n = F.col("s_suppkey")
    tags = [(n % 3 > 0, F.when(n % 2 == 0, "DWG NO").otherwise("sheet_no"), F.concat(F.lit("A-"), n)), (n % 2 == 0, F.when(n % 4 == 0, "Drawing-Title").otherwise("도면명"), F.col("s_name")), (n % 5 > 0, F.lit("SCALE.A1"), F.lit("1:100")), (F.lit(True), F.lit("CHECKED BY"), F.lit("x"))]
    rows = t("supplier").select(n.alias("id"), F.posexplode(F.array_compact(F.array(*[F.when(ok, F.struct(tag.alias("tag"), value.alias("value"))) for ok, tag, value in tags]))).alias("pos", "a"))
    found = relations.attribute_map(rows.select("id", "pos", "a.tag", "a.value")).withColumn("block", relations.title_block(F.col("attributes")))
    return found.where("block is not null").select("id", F.col("block.drawingNumber").alias("number"), F.col("block.drawingTitle").alias("title"), "block.scale")


@query("P-13", "SELECT s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey % 2 = 0")
def gis_objects(t, spark):
    """Features with a name become objects of the canonical form."""
    n = F.col("s_suppkey")
    one = text_of('{"type":"Feature","id":"', n, '","properties":{', F.when(n % 2 == 0, text_of('"name":"', F.col("s_name"), '"')).otherwise(""), '},"geometry":{"type":"Point","coordinates":[', n, ",1]}}")
    rows = files.geojson(spark, stored(t("supplier"), "s_suppkey", one))
    named = rows.withColumn("label", F.get_json_object("properties", "$.name")).where("label is not null")
    return named.select(F.col("feature_id").cast("long").alias("id"), "label")
