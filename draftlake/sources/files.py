"""Readers on Spark's own file sources, so that any path that Spark opens can be read.

Formats made of lines or JSON are parsed by column expressions; binary and stateful ones by a generator over batches
of files (mapInPandas), one row in, many rows out. A file that cannot be parsed gives a row with its error instead of
ending the scan.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.sources import statements

#: Release names by the first six bytes of a drawing; fixed values.
RELEASES = {"AC1006": "R10", "AC1009": "R11/R12", "AC1012": "R13", "AC1014": "R14", "AC1015": "2000", "AC1018": "2004", "AC1021": "2007", "AC1024": "2010", "AC1027": "2013", "AC1032": "2018"}
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def whole_text(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, value: one row a file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), "value")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def release(content: Column) -> Column:
    """Release name of a drawing from its signature."""
    return F.create_map(*[F.lit(x) for kv in RELEASES.items() for x in kv])[F.decode(F.substring(content, 1, 6), "ISO-8859-1")]


def census(spark: SparkSession, path: str, extensions: list[str] | None = None, exclude: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """path, ext, size, modified, sha256, release of every file but empty ones; files whose (path, size, modified) are known are not read."""
    files = binary(spark, path).withColumn("ext", extension(F.col("path")))
    if extensions:
        files = files.where(F.col("ext").isin(extensions))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    if known is not None:
        files = files.join(known.select("path", F.col("size").alias("length"), F.col("modified").alias("modificationTime")), ["path", "length", "modificationTime"], "left_anti")
    return files.select("path", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), release(F.col("content")).alias("release"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a torn or malformed line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_per_key(spark: SparkSession, path: str, schema: str, key: str, glob: str = "*") -> DataFrame:
    """JSON lines of which the last record of each key counts, in the order of files and of lines within each."""
    rows = statements.records(spark, path, glob)
    rows = rows.select(statements.place().alias("place"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", "place").alias("r")).select("r.*")


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and relations of canonical documents, with defaults for what is missing."""
    schema = (
        "project_id string, snapshot_id string, objects array<struct<id:string,type:string,source:struct<file:string,format:string,entity_id:string,layer:string>,"
        "bbox:struct<min_x:double,min_y:double,max_x:double,max_y:double>,properties:map<string,string>,classification:struct<label:string,confidence:double,method:string,state:string>>>,"
        "relations array<struct<subject:string,predicate:string,object:string,confidence:double>>"
    )
    docs = spark.read.option("multiLine", "true").schema(schema).json(path)
    objects = docs.select("project_id", F.explode("objects").alias("o")).select("project_id", "o.*")
    objects = objects.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    relations = docs.select("project_id", F.explode("relations").alias("r")).select("project_id", "r.*").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return objects, relations


def coordinates(geometry: Column) -> Column:
    """All positions of a GeoJSON geometry of any depth."""
    pairs = F.regexp_extract_all(geometry, F.lit(rf"\[\s*({NUMBER})\s*,\s*({NUMBER})"), F.lit(0))
    numbers = F.transform(pairs, lambda p: F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0)))
    return F.transform(numbers, lambda n: F.struct(n[0].cast("double").alias("x"), n[1].cast("double").alias("y")))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """path, feature_id, geometry_type, geometry, properties, crs and box; a collection or a single feature."""
    feature = "struct<id:string,type:string,geometry:string,properties:string,bbox:array<double>>"
    schema = f"type string, id string, geometry string, properties string, bbox array<double>, crs struct<properties:struct<name:string,href:string>>, features array<{feature}>"
    docs = whole_text(spark, path).select("path", F.from_json("value", schema).alias("d"))
    one = F.array(F.struct("d.id", "d.type", "d.geometry", "d.properties", "d.bbox"))
    rows = docs.select("path", F.coalesce("d.crs.properties.name", "d.crs.properties.href").alias("crs"), F.posexplode(F.when(F.col("d.type") == "Feature", one).otherwise(F.col("d.features"))).alias("pos", "f"))
    points = coordinates(F.col("f.geometry"))
    rows = rows.select("path", "crs", "pos", "f", F.explode(F.array(points)).alias("points"))
    side = lambda axis, fn: fn(F.transform("points", lambda p: p[axis]))
    box = [side("x", F.array_min), side("y", F.array_min), side("x", F.array_max), side("y", F.array_max)]
    half = (F.size("f.bbox") / 2).cast("int")
    given = [F.col("f.bbox")[0], F.col("f.bbox")[1], F.col("f.bbox")[half], F.col("f.bbox")[half + 1]]
    names = ("min_x", "min_y", "max_x", "max_y")
    return rows.select(
        "path", F.coalesce("f.id", F.col("pos").cast("string")).alias("feature_id"), F.get_json_object("f.geometry", "$.type").alias("geometry_type"),
        F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"), "crs",
        *[F.when(F.size("f.bbox") >= 4, g).otherwise(b).alias(n) for n, g, b in zip(names, given, box, strict=True)],
    )


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Header, bounds and statistics of ESRI grids; nodata cells do not count."""
    head = lambda key: F.regexp_extract("value", rf"(?i)\b{key}\s+({NUMBER})", 1).try_cast("double")
    rows = whole_text(spark, path)
    body = F.regexp_replace("value", r"(?im)^\s*(ncols|nrows|xllcorner|yllcorner|xllcenter|yllcenter|cellsize|nodata_value)\s+.*$", "")
    cells = F.transform(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    rows = rows.select("path", *[head(k).alias(k) for k in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")], F.explode(F.array(cells)).alias("cells"))
    rows = rows.withColumn("valid", F.filter("cells", lambda x: F.col("nodata_value").isNull() | (x != F.col("nodata_value"))))
    return rows.select(
        "path", F.col("ncols").cast("int").alias("width"), F.col("nrows").cast("int").alias("height"), F.col("xllcorner").alias("min_x"), F.col("yllcorner").alias("min_y"),
        (F.col("xllcorner") + F.col("ncols") * F.col("cellsize")).alias("max_x"), (F.col("yllcorner") + F.col("nrows") * F.col("cellsize")).alias("max_y"),
        F.size("valid").alias("cells"), F.array_min("valid").alias("least"), F.array_max("valid").alias("most"),
        F.when(F.size("valid") > 0, F.aggregate("valid", F.lit(0.0), lambda s, x: s + x) / F.size("valid")).alias("mean"),
    )


def obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices, faces, groups and bounds of Wavefront models, line by line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("w"))
    vertex, at = F.col("w")[0] == "v", lambda k: F.when(F.col("w")[0] == "v", F.try_element_at("w", F.lit(k + 2)).try_cast("double"))
    sides = [f(at(k)).alias(f"{n}_{a}") for k, a in enumerate("xyz") for n, f in (("min", F.min), ("max", F.max))]
    return lines.groupBy("path").agg(F.count_if(vertex).alias("vertices"), F.count_if(F.col("w")[0] == "f").alias("faces"), F.count_if(F.col("w")[0].isin("g", "o")).alias("groups"), *sides)


def step_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Entity types of Part-21 files with counts."""
    return statements.entities(spark, path).groupBy("path", "type").agg(F.count("*").alias("n"))


def ifc(spark: SparkSession, path: str) -> DataFrame:
    """path, id, type, global_id, name, e (the statement) of every entity of IFC files, whatever the size of either."""
    rows = statements.entities(spark, path).where(F.startswith("type", F.lit("IFC")))
    own = rf"\A\s*({statements.QUOTED})\s*,[^,()']*+,\s*({statements.QUOTED})?"
    body = F.expr("substring(e, instr(e, '(') + 1)")
    part = lambda k: F.nullif(F.regexp_extract(body, own, k), F.lit(""))
    return rows.select("path", "id", "type", *[F.coalesce(statements.unquoted(part(k)), F.lit("")).alias(n) for k, n in ((1, "global_id"), (2, "name"))], "e")


#: Relation classes: places of the relating and related arguments, predicate; fixed values.
IFC_RELATIONS = {"IFCRELAGGREGATES": (4, 5, "aggregates"), "IFCRELCONTAINEDINSPATIALSTRUCTURE": (5, 4, "contains"), "IFCRELVOIDSELEMENT": (4, 5, "voids"), "IFCRELFILLSELEMENT": (4, 5, "fills"), "IFCRELDEFINESBYTYPE": (5, 4, "defines")}


def ifc_relations(entities: DataFrame) -> DataFrame:
    """subject, predicate, object ids of the relation classes."""
    rows = entities.where(F.col("type").isin(list(IFC_RELATIONS))).select("path", "type", F.explode(F.array(statements.arguments(F.col("e")))).alias("a"))
    refs = lambda k: F.regexp_extract_all(F.get("a", F.lit(k)), F.lit(r"#(\d+)"), F.lit(1))
    ladder = [F.when(F.col("type") == kind, F.struct(F.get(refs(a), F.lit(0)).cast("long").alias("subject"), F.lit(name).alias("predicate"), refs(b).alias("objects"))) for kind, (a, b, name) in IFC_RELATIONS.items()]
    rows = rows.select("path", F.explode(F.array(F.coalesce(*ladder))).alias("r"))
    return rows.select("path", "r.subject", "r.predicate", F.explode("r.objects").alias("object")).withColumn("object", F.col("object").cast("long"))


def svg(spark: SparkSession, path: str) -> DataFrame:
    """Elements of SVG files by local name, with the view box."""
    rows = whole_text(spark, path)
    box = F.regexp_extract("value", r"(?i)viewBox\s*=\s*[\"']([^\"']*)", 1)
    return rows.select("path", box.alias("view_box"), F.explode(tags(F.col("value"))).alias("tag")).groupBy("path", "view_box", "tag").agg(F.count("*").alias("n"))


def tags(markup: Column) -> Column:
    """Local names of the elements that a markup text opens."""
    return F.regexp_extract_all(markup, F.lit(r"<(?:[A-Za-z][\w.-]*:)?([A-Za-z][\w.-]*)"), F.lit(1))


def gltf(spark: SparkSession, path: str, glob: str = "*.gltf") -> DataFrame:
    """Structure counts of glTF files."""
    keys = ("scenes", "nodes", "meshes", "materials", "accessors", "buffers")
    schema = "asset struct<version:string>, " + ", ".join(f"{k} array<string>" for k in keys)
    docs = whole_text(spark, path, glob).select("path", F.from_json("value", schema).alias("d"))
    return docs.select("path", "d.asset.version", *[F.coalesce(F.size(f"d.{k}"), F.lit(0)).alias(k) for k in keys])


def parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of a parser over binary files; an error becomes a row with `error`."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(parse(path, content))
                except (ValueError, KeyError, IndexError, struct.error, UnicodeDecodeError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


DXF = "path string, handle string, entity_type string, layer string, block string, text string, points array<array<double>>, radius double, start double, end double, layout string, owner string, attributes map<string,string>, color int, error string"


def decoded(content: bytes) -> str:
    """UTF-8 if it is, else CP949 where that gives Hangul, else Latin-1; \\U+XXXX escapes resolved."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("cp949", "replace")
        hangul, strange = len(re.findall("[가-힣]", text)), len(re.findall(r"[^\x00-\x7f]", text))
        if hangul < 2 or hangul < 0.6 * strange:
            text = content.decode("latin-1")
    return re.sub(r"\\U\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), text)


def parse_dxf(path: str, content: bytes) -> Iterator[dict]:
    """Entities of ENTITIES and BLOCKS and the layers of TABLES: pairs of lines, a group code and its value.

    `owner` is the block definition that an entity belongs to. A polyline takes the points of its vertices, an insert
    the attributes that follow it.
    """
    lines = decoded(content).splitlines()
    pairs = [(int(lines[k]), lines[k + 1].strip()) for k in range(0, len(lines) - 1, 2)]
    out: list[dict] = []
    section, owner, host, entity = None, None, None, None
    floats = {40: "radius", 50: "start", 51: "end"}

    def close() -> None:
        nonlocal owner, host
        if entity is None:
            return
        kind = entity["entity_type"]
        points = [[x, y] for x, y in zip(entity.pop("xs"), entity.pop("ys"), strict=False)]
        if section == "BLOCKS" and kind in ("BLOCK", "ENDBLK"):
            owner = entity.get("block") if kind == "BLOCK" else None
        elif section == "TABLES" and kind == "LAYER":
            out.append(entity | {"layer": entity.get("block"), "block": None, "layout": "Table", "points": []})
        elif kind == "VERTEX" and host:
            host["points"] += points
        elif kind == "ATTRIB" and host:
            host["attributes"][entity.get("block") or ""] = entity.get("text", "")
        elif kind == "SEQEND":
            host = None
        elif section in ("ENTITIES", "BLOCKS"):
            own = entity | {"points": points if kind != "POLYLINE" else [], "owner": owner, "attributes": {}}
            if section == "BLOCKS":
                own["layout"] = "Block"
            out.append(own)
            host = own if kind in ("POLYLINE", "INSERT") else None

    for k, (code, value) in enumerate(pairs):
        if code == 0:
            close()
            entity = None
            if value == "ENDSEC":
                section = None
            elif value != "SECTION":
                entity = {"path": path, "entity_type": value, "layout": "Model", "xs": [], "ys": []}
            continue
        if entity is None:
            if code == 2 and k and pairs[k - 1] == (0, "SECTION"):
                section = value
            continue
        if code in (5, 8, 2):
            entity[{5: "handle", 8: "layer", 2: "block"}[code]] = value
        elif code in (1, 3):
            entity["text"] = entity.get("text", "") + value
        elif code in (10, 11):
            entity["xs"].append(float(value))
        elif code in (20, 21):
            entity["ys"].append(float(value))
        elif code in floats:
            entity[floats[code]] = float(value)
        elif code == 62:
            entity["color"] = int(value)
        elif code == 67 and value == "1":
            entity["layout"] = "Paper"
    close()
    yield from out


def dxf(spark: SparkSession, path: str, glob: str = "*.dxf") -> DataFrame:
    """Normalised entities of DXF files with their boxes."""
    rows = parsed(binary(spark, path, glob), parse_dxf, DXF).where("layout is null or layout in ('Model', 'Paper')")
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    grow = F.when(F.col("entity_type").isin("CIRCLE", "ARC"), F.coalesce("radius", F.lit(0.0))).otherwise(0.0)
    return rows.select("*", (F.array_min(xs) - grow).alias("min_x"), (F.array_min(ys) - grow).alias("min_y"), (F.array_max(xs) + grow).alias("max_x"), (F.array_max(ys) + grow).alias("max_y"))


def dxf_blocks(spark: SparkSession, path: str, glob: str = "*.dxf") -> DataFrame:
    """Block definitions: path, name, entities, the blocks that they insert."""
    rows = parsed(binary(spark, path, glob), parse_dxf, DXF).where("layout = 'Block'")
    nested = F.collect_set(F.when(F.col("entity_type") == "INSERT", F.col("block")))
    return rows.groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("entities"), F.array_sort(nested).alias("inserts"))


def dxf_layers(spark: SparkSession, path: str, glob: str = "*.dxf") -> DataFrame:
    """The layer table: path, name, color, frozen or off layers with a negative color."""
    return parsed(binary(spark, path, glob), parse_dxf, DXF).where("layout = 'Table'").select("path", F.col("layer").alias("name"), "color")


def extents(entities: DataFrame) -> DataFrame:
    """Model-space extents of each file."""
    return entities.where("layout = 'Model'").groupBy("path").agg(F.count("*").alias("entities"), F.countDistinct("layer").alias("layers"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


STL = "path string, kind string, facets long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, error string"


def parse_stl(path: str, content: bytes) -> Iterator[dict]:
    import numpy as np

    if len(content) >= 84 and len(content) == 84 + 50 * struct.unpack("<I", content[80:84])[0]:
        kind, n = "binary", struct.unpack("<I", content[80:84])[0]
        corners = np.frombuffer(content, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)["v"].reshape(-1, 3)
    else:
        kind = "ascii"
        found = re.findall(rf"vertex\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})", content.decode("latin-1"))
        corners = np.array(found, float).reshape(-1, 3)
        n = len(corners) // 3
    row = {"path": path, "kind": kind, "facets": n}
    if len(corners):
        row |= {f"{s}_{a}": float(f(corners[:, k])) for k, a in enumerate("xyz") for s, f in (("min", np.min), ("max", np.max))}
    yield row


def stl(spark: SparkSession, path: str, glob: str = "*.stl") -> DataFrame:
    return parsed(binary(spark, path, glob), parse_stl, STL)


def parse_glb(path: str, content: bytes) -> Iterator[dict]:
    magic, version, _ = struct.unpack("<4sII", content[:12])
    if magic != b"glTF":
        raise ValueError("not a GLB file")
    at, chunks, doc = 12, 0, {}
    while at + 8 <= len(content):
        size, kind = struct.unpack("<I4s", content[at : at + 8])
        if kind == b"JSON":
            doc = json.loads(content[at + 8 : at + 8 + size])
        chunks, at = chunks + 1, at + 8 + size
    yield {"path": path, "version": version, "chunks": chunks, "nodes": len(doc.get("nodes", [])), "meshes": len(doc.get("meshes", []))}


def glb(spark: SparkSession, path: str, glob: str = "*.glb") -> DataFrame:
    return parsed(binary(spark, path, glob), parse_glb, "path string, version int, chunks int, nodes int, meshes int, error string")


def parse_pdf(path: str, content: bytes) -> Iterator[dict]:
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    boxes = re.findall(rb"/MediaBox\s*\[\s*([^\]]+)\]", content)
    sizes = [[float(x) for x in b.split()[:4]] for b in boxes]
    yield {"path": path, "version": content[5:8].decode("latin-1"), "pages": len(re.findall(rb"/Type\s*/Page(?![s\w])", content)), "images": len(re.findall(rb"/Subtype\s*/Image", content)), "width": sizes[0][2] - sizes[0][0] if sizes else None, "height": sizes[0][3] - sizes[0][1] if sizes else None}


def pdf(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return parsed(binary(spark, path, glob), parse_pdf, "path string, version string, pages int, images int, width double, height double, error string")


SHAPE = "path string, record long, shape string, parts int, points long, min_x double, min_y double, max_x double, max_y double, error string"
#: Shape types by number; fixed values.
SHAPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ", 18: "MultiPointZ", 21: "PointM", 23: "PolyLineM", 25: "PolygonM", 28: "MultiPointM"}


def parse_shp(path: str, content: bytes) -> Iterator[dict]:
    """Records of a shapefile: big-endian record headers, little-endian shapes."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("a record header is cut off")
        record, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        if len(body) < 2 * words or words < 2:
            raise ValueError(f"record {record} is cut off")
        kind = SHAPES.get(struct.unpack("<i", body[:4])[0])
        if kind is None:
            raise ValueError(f"record {record} has an unknown shape")
        row = {"path": path, "record": record, "shape": kind, "parts": 0, "points": 0}
        if kind.startswith("Point"):
            x, y = struct.unpack("<2d", body[4:20])
            row |= {"parts": 1, "points": 1, "min_x": x, "min_y": y, "max_x": x, "max_y": y}
        elif kind != "Null":
            row |= dict(zip(("min_x", "min_y", "max_x", "max_y"), struct.unpack("<4d", body[4:36]), strict=True))
            first, second = struct.unpack("<2i", body[36:44]) if len(body) >= 44 else (struct.unpack("<i", body[36:40])[0], 0)
            row |= {"parts": 1, "points": first} if kind.startswith("Multi") else {"parts": first, "points": second}
        yield row
        at += 8 + 2 * words


def shapefile(spark: SparkSession, path: str, glob: str = "*.shp") -> DataFrame:
    """Records of shapefiles with their boxes."""
    return parsed(binary(spark, path, glob), parse_shp, SHAPE)


DBF = "path string, record long, deleted boolean, fields map<string,string>, error string"


def parse_dbf(path: str, content: bytes) -> Iterator[dict]:
    """Rows of a dBASE table: field descriptors of 32 bytes, then rows of fixed width."""
    if len(content) < 33:
        raise ValueError("not a dBASE table")
    n, start, width = struct.unpack("<IHH", content[4:12])
    columns, at, place = [], 32, 1
    while at + 32 <= start and content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        columns.append((name, place, place + content[at + 16]))
        place += content[at + 16]
        at += 32
    for k in range(n):
        row = content[start + k * width : start + (k + 1) * width]
        if len(row) < width:
            raise ValueError(f"row {k} is cut off")
        yield {"path": path, "record": k + 1, "deleted": row[:1] == b"*", "fields": {c: decoded(row[a:b]).strip() for c, a, b in columns}}


def dbf(spark: SparkSession, path: str, glob: str = "*.dbf") -> DataFrame:
    """Attribute rows of shapefiles; join them by path stem and record number."""
    return parsed(binary(spark, path, glob), parse_dbf, DBF)


TIFF = "path string, width int, height int, bands int, bits int, pixel_x double, pixel_y double, min_x double, min_y double, max_x double, max_y double, epsg int, nodata string, error string"
#: Bytes of a value of each TIFF field type; fixed values.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}


def parse_tiff(path: str, content: bytes) -> Iterator[dict]:
    """Size, georeference and projection code out of the tags of a GeoTIFF's first image; classic and big files."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    version = struct.unpack(order + "H", content[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), content[8:16] if big else content[4:8])[0]
    head, entry, wide = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(order + ("Q" if big else "H"), content[at : at + head])[0]
    tags: dict[int, tuple] = {}
    letters = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
    for k in range(n):
        e = content[at + head + k * entry : at + head + (k + 1) * entry]
        tag, kind, count = struct.unpack(order + "HH" + wide, e[: 4 + struct.calcsize(wide)])
        size = TIFF_SIZES.get(kind, 0) * count
        inline = e[4 + struct.calcsize(wide) :]
        raw = inline[:size] if size <= len(inline) else content[(p := struct.unpack(order + wide, inline)[0]) : p + size]
        if kind == 2:
            tags[tag] = (raw.split(b"\0")[0].decode("latin-1"),)
        elif kind in letters:
            tags[tag] = struct.unpack(f"{order}{count}{letters[kind]}", raw)
    width, height = tags[256][0], tags[257][0]
    row = {"path": path, "width": width, "height": height, "bands": tags.get(277, (1,))[0], "bits": tags.get(258, (1,))[0], "nodata": tags.get(42113, (None,))[0]}
    if 33550 in tags and 33922 in tags:  # pixel size, and a pixel's place in the world
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
        left, top = x - i * sx, y + j * sy
        row |= {"pixel_x": sx, "pixel_y": sy, "min_x": left, "max_x": left + width * sx, "max_y": top, "min_y": top - height * sy}
    keys = tags.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    row["epsg"] = codes.get(3072, codes.get(2048))
    yield row


def geotiff(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """Size, box and projection of rasters, from their tags; pixels are not read."""
    return parsed(binary(spark, path, glob), parse_tiff, TIFF)


def ini(spark: SparkSession, path: str) -> DataFrame:
    """path, section, key, value of sectioned files: the header carries down to the lines below it."""
    rows = whole_text(spark, path).select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    header = F.when(F.col("text").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("text", r"\[(.*)\]", 1))
    over = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(header, ignorenulls=True).over(over)).where(F.col("text").rlike(r"^\s*[^\[;#=][^=]*="))
    return rows.select("path", "line", "section", F.trim(F.regexp_extract("text", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("text", "=(.*)$", 1)).alias("value"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Names, descriptions and definition lines of hatch (.pat) and line type (.lin) files."""
    rows = whole_text(spark, path).select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(~F.col("text").rlike(r"^\s*(;|$)"))
    name = F.when(F.startswith("text", F.lit("*")), F.regexp_extract("text", r"^\*([^,]*)", 1))
    over = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("name", F.last(name, ignorenulls=True).over(over)).where("name is not null")
    return rows.groupBy("path", "name").agg(F.max(F.when(F.startswith("text", F.lit("*")), F.trim(F.regexp_extract("text", ",(.*)$", 1)))).alias("description"), F.count_if(~F.startswith("text", F.lit("*"))).alias("definitions"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """Command aliases of .pgp files."""
    rows = whole_text(spark, path).select("path", F.explode(F.split("value", "\r?\n")).alias("text"))
    return rows.where(F.col("text").rlike(r"^\s*[^;\s][^,]*,\s*\*")).select("path", F.trim(F.regexp_extract("text", "^([^,]*),", 1)).alias("alias"), F.trim(F.regexp_extract("text", r"\*(.*)$", 1)).alias("command"))


def sections_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CP949 section tables with eleven fields or more; the first of each key counts."""
    rows = spark.read.option("encoding", "cp949").text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    rows = rows.select("line", F.split(F.trim("text"), r"\s+").alias("w")).where(F.size("w") >= 11)
    return rows.select("line", F.col("w")[0].alias("key"), F.transform(F.slice("w", 2, 100), lambda x: x.try_cast("double")).alias("numbers")).groupBy("key").agg(F.min_by("numbers", "line").alias("numbers"))


def worker_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, job, event of claim and done lines."""
    rows = spark.read.text(path)
    pattern = r"^(\S+ \S+).*\b(claim|done)\b.*job[= ](\S+)"
    return rows.where(F.col("value").rlike(pattern)).select(F.to_timestamp(F.regexp_extract("value", pattern, 1)).alias("ts"), F.regexp_extract("value", pattern, 3).alias("job"), F.regexp_extract("value", pattern, 2).alias("event"))


def code_tree(spark: SparkSession, path: str, extensions: list[str], most: int = 1 << 20) -> DataFrame:
    """path, sha256, size of source files."""
    files = binary(spark, path).where(extension(F.col("path")).isin(extensions) & (F.col("length") <= most))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def knowledge_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and aliases of knowledge packs; check them with operators.joins.dangling."""
    schema = "schema string, nodes array<struct<id:string,type:string,name:string,text:string>>, edges array<struct<src:string,predicate:string,dst:string>>, aliases array<array<string>>"
    docs = spark.read.option("multiLine", "true").schema(schema).json(path)
    nodes, edges = (docs.select(F.explode(c).alias("x")).select("x.*") for c in ("nodes", "edges"))
    names = docs.select(F.explode("aliases").alias("a")).select(F.col("a")[0].alias("alias_type"), F.col("a")[1].alias("alias"), F.col("a")[2].alias("node_id"))
    return nodes, edges, names


READERS = {"dxf": dxf, "ifc": ifc, "geojson": geojson, "asc": ascii_grid, "dem": ascii_grid, "obj": obj, "stl": stl, "gltf": gltf, "glb": glb, "stp": step_histogram, "step": step_histogram, "svg": svg, "pdf": pdf, "shp": shapefile, "dbf": dbf, "tif": geotiff, "tiff": geotiff, "ini": ini, "cfg": ini, "pat": patterns, "lin": patterns, "pgp": aliases}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader of a path's extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind](spark, path)
