"""Readers and text sinks on small files."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from draftlake.operators import joins
from draftlake.sinks import text as sinks
from draftlake.sources import files, statements


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def dxf_text(*entities):
    pairs = [(0, "SECTION"), (2, "ENTITIES"), *[p for e in entities for p in e], (0, "ENDSEC"), (0, "EOF")]
    return "\n".join(f"{c}\n{v}" for c, v in pairs) + "\n"


def test_dxf(spark, tmp_path):
    line = [(0, "LINE"), (5, "A1"), (8, "A-WALL"), (10, "0"), (20, "0"), (11, "4"), (21, "3")]
    circle = [(0, "CIRCLE"), (5, "A2"), (8, "A-COLS"), (10, "10"), (20, "10"), (40, "2")]
    note = [(0, "TEXT"), (5, "A3"), (8, "0"), (67, "1"), (10, "1"), (20, "1"), (1, "\\U+AC70실")]
    put(tmp_path, "a.dxf", dxf_text(line, circle, note))
    put(tmp_path, "b.dxf", "not\na\ndxf")
    put(tmp_path, "c.dxf", dxf_text([(0, "TEXT"), (5, "C"), (8, "벽체"), (1, "거실 창문"), (10, "0"), (20, "0")]).encode("cp949"))
    rows = files.dxf(spark, str(tmp_path)).collect()
    by = {r.handle: r for r in rows if r.handle}
    assert (by["A1"].layer, by["A1"].max_x, by["A1"].max_y) == ("A-WALL", 4.0, 3.0)
    assert (by["A2"].min_x, by["A2"].max_y) == (8.0, 12.0)
    assert by["A3"].text == "거실" and by["A3"].layout == "Paper" and by["C"].layer == "벽체"
    assert sum(r.error is not None for r in rows) == 1
    box = files.extents(files.dxf(spark, str(tmp_path)).where("handle is not null and path like '%a.dxf'")).first()
    assert (box.entities, box.layers, box.min_x, box.max_x) == (2, 2, 0.0, 12.0)
    assert [r.line[:7] for r in sinks.svg_lines(files.dxf(spark, str(tmp_path)).where("entity_type = 'CIRCLE'")).collect()] == ["<circle"]


def test_geojson_and_grid(spark, tmp_path):
    doc = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:5179"}}, "features": [
        {"type": "Feature", "id": "b1", "properties": {"kind": "building"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 2.5], [0, 0]]]}},
        {"type": "Feature", "properties": {}, "bbox": [9, 8, 7, 6], "geometry": {"type": "Point", "coordinates": [1e1, -2]}}]}
    path = put(tmp_path, "site.geojson", json.dumps(doc))
    rows = files.geojson(spark, path).orderBy("feature_id").collect()
    assert [(r.feature_id, r.geometry_type, r.crs) for r in rows] == [("1", "Point", "EPSG:5179"), ("b1", "Polygon", "EPSG:5179")]
    assert (rows[1].min_x, rows[1].max_x, rows[1].max_y) == (0.0, 4.0, 2.5) and (rows[0].min_x, rows[0].max_y) == (9.0, 6.0)
    one = put(tmp_path, "one.geojson", json.dumps(doc["features"][0]))
    assert files.geojson(spark, one).count() == 1
    grid = put(tmp_path, "t.dem", "ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2 3\n4 -9999 5\n")
    r = files.ascii_grid(spark, grid).first()
    assert (r.width, r.height, r.min_x, r.max_x, r.max_y, r.cells, r.least, r.most, r["mean"]) == (3, 2, 100.0, 130.0, 220.0, 5, 1.0, 5.0, 3.0)


def test_models(spark, tmp_path):
    o = files.obj(spark, put(tmp_path, "m.obj", "o cube\nv 0 0 0\nv 1 2 3\nf 1 2 1\n# note\n")).first()
    assert (o.vertices, o.faces, o.groups, o.max_y) == (2, 1, 1, 2.0)
    put(tmp_path, "a.stl", "solid x\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 2 0\nendloop\nendfacet\nendsolid")
    put(tmp_path, "b.stl", bytes(80) + struct.pack("<I", 1) + struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 3, 0, 0, 0, 0, 5, 0))
    got = {r.kind: r for r in files.stl(spark, str(tmp_path)).collect()}
    assert got["ascii"].facets == 1 and got["binary"].max_z == 5.0
    body = json.dumps({"nodes": [{}, {}], "meshes": [{}]}).encode()
    put(tmp_path, "g.glb", struct.pack("<4sII", b"glTF", 2, 20 + len(body)) + struct.pack("<I4s", len(body), b"JSON") + body)
    put(tmp_path, "bad.glb", b"x" * 20)
    got = files.glb(spark, str(tmp_path)).collect()
    assert sorted((r.nodes or 0, r.error is None) for r in got) == [(0, False), (2, True)]
    put(tmp_path, "s.gltf", json.dumps({"asset": {"version": "2.0"}, "nodes": [{}, {}, {}]}))
    assert files.gltf(spark, str(tmp_path)).first().nodes == 3
    step = put(tmp_path, "m.step", "ISO-10303-21;\nDATA;\n#1=POINT('',1.);\n#2 = POINT('',2.);\n#3=LINE(#1,#2);\nENDSEC;")
    assert {r.type: r.n for r in files.step_histogram(spark, step).collect()} == {"POINT": 2, "LINE": 1}


def test_ifc(spark, tmp_path):
    text = "DATA;\n#1=IFCPROJECT('p',$,'House (1; a)',$);\n#2=IFCSITE('s',$,'Site',$);\n#3=IFCWALL('w',$,'Wall',$);\n#4=IFCRELAGGREGATES('r',$,$,$,#1,(#2));\n#5=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(#3),#2);\nENDSEC;"
    entities = files.ifc(spark, put(tmp_path, "h.ifc", text))
    assert {(r.id, r.type, r.name) for r in entities.where("type not like 'IFCREL%'").collect()} == {(1, "IFCPROJECT", "House (1; a)"), (2, "IFCSITE", "Site"), (3, "IFCWALL", "Wall")}
    assert {tuple(r)[1:] for r in files.ifc_relations(entities).collect()} == {(1, "aggregates", 2), (2, "contains", 3)}


def test_documents(spark, tmp_path):
    svg = put(tmp_path, "d.svg", '<svg viewBox="0 0 10 10"><g><path d=""/><svg:path/></g></svg>')
    assert {(r.tag, r.n) for r in files.svg(spark, svg).collect()} == {("svg", 1), ("g", 1), ("path", 2)}
    put(tmp_path, "p.pdf", b"%PDF-1.7\n<</Type /Pages>><</Type /Page /MediaBox [0 0 595 842]>><</Type/Page>>")
    r = files.pdf(spark, str(tmp_path)).first()
    assert (r.version, r.pages, r.height) == ("1.7", 2, 842.0)
    ini = put(tmp_path, "c.ini", "x=0\n[One]\na = 1\n; note\n[Two]\nb=2=3\n")
    assert [(r.section, r.key, r.value) for r in files.ini(spark, ini).orderBy("line").collect()] == [(None, "x", "0"), ("One", "a", "1"), ("Two", "b", "2=3")]
    lin = put(tmp_path, "l.lin", ";;\n*DASH,Dashed __ __\nA,.5,-.25\n*DOT,Dots\nA,0,-.25\n")
    assert {(r.name, r.description, r.definitions) for r in files.patterns(spark, lin).collect()} == {("DASH", "Dashed __ __", 1), ("DOT", "Dots", 1)}
    assert files.aliases(spark, put(tmp_path, "a.pgp", "; x\nL, *LINE\n")).first().command == "LINE"
    log = put(tmp_path, "w.log", "2024-01-01 10:00:00 worker claim job=a\nnoise\n2024-01-01 10:05:00 worker done job=a\n")
    rows = files.worker_log(spark, log)
    pairs = joins.as_of(rows.where("event = 'done'"), rows.where("event = 'claim'").select("job", F.col("ts").alias("at"), F.col("ts").alias("began")), ["job"], "ts", "at", "began", "began")
    assert (pairs.first().ts - pairs.first().began).seconds == 300


def test_census_and_records(spark, tmp_path):
    put(tmp_path, "a.dwg", b"AC1027 rest")
    put(tmp_path, "b.txt", b"x")
    rows = {r.ext: r for r in files.census(spark, str(tmp_path)).collect()}
    assert rows["dwg"].release == "2013" and rows["txt"].release is None and len(rows["dwg"].sha256) == 64
    known = files.census(spark, str(tmp_path), ["dwg"])
    assert files.census(spark, str(tmp_path), ["dwg"], known=known).count() == 0
    lines = put(tmp_path, "r.jsonl", '{"k":"a","v":1}\n{"k":"b","v":2}\n{"k":"a","v":3}\n{"k":"c",')
    assert {(r.k, r.v) for r in files.last_per_key(spark, lines, "k string, v int", "k").collect()} == {("a", 3), ("b", 2)}
    assert files.jsonl(spark, lines, "k string, v int").count() == 3
    pack = put(tmp_path, "pack.json", json.dumps({"schema": "x", "nodes": [{"id": "1", "type": "T", "name": "n"}], "edges": [{"src": "1", "predicate": "p", "dst": "2"}], "aliases": [["t", "a", "1"]]}))
    nodes, edges, names = files.knowledge_pack(spark, pack)
    assert joins.dangling(edges, "dst", nodes, "id").count() == 1 and names.first().node_id == "1"
    snap = put(tmp_path, "snap.json", json.dumps({"project_id": "P", "objects": [{"id": "o", "type": "Wall"}], "relations": [{"subject": "o", "predicate": "p", "object": "q"}]}))
    objects, relations = files.snapshot(spark, snap)
    assert objects.first().properties == {} and relations.first().confidence == 1.0


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T", 'x "y" \\'), ("b", "T", "<&>")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "p", "b")], "src string, predicate string, dst string")
    lines = [r.line for r in sinks.cypher_nodes(nodes).collect()]
    assert lines[0] == 'MERGE (n:T {id: "a"}) SET n.name = "x \\"y\\" \\\\";'
    sinks.write_lines(sinks.graphml(nodes, edges), str(tmp_path / "g"), "part", "line")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    assert text.count("<node") == 2 and text.count("<edge") == 1
    sinks.write_table(nodes, str(tmp_path / "t"), "csv", ["type"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2


def test_shapefile_and_its_table(spark, tmp_path):
    import struct

    ring = struct.pack("<i4d2i", 5, 0.0, 0.0, 2.0, 1.0, 1, 4) + struct.pack("<i8d", 0, 0, 0, 2, 0, 2, 1, 0, 0)
    bodies = [struct.pack("<i2d", 1, 7.5, 8.5), ring, struct.pack("<i", 0)]
    records = b"".join(struct.pack(">ii", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    (tmp_path / "a.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + records)
    (tmp_path / "bad.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + records[:-4])
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15) + b"N".ljust(11, b"\0") + b"N" + bytes(4) + bytes([3]) + bytes(15) + b"\r"
    rows = b" " + "문".encode("cp949").ljust(6) + b" 12" + b"*" + b"gone  " + b"  1"
    (tmp_path / "a.dbf").write_bytes(bytes(4) + struct.pack("<IHH", 2, 32 + len(fields), 10) + bytes(20) + fields + rows)
    got = {r.record: r for r in files.shapefile(spark, str(tmp_path)).where("path like '%a.shp'").collect()}
    assert (got[1].shape, got[1].min_x, got[1].max_y) == ("Point", 7.5, 8.5) and (got[2].parts, got[2].points, got[2].max_x) == (1, 4, 2.0) and got[3].shape == "Null"
    assert files.shapefile(spark, str(tmp_path)).where("error is not null").count() == 1
    table = {r.record: r for r in files.dbf(spark, str(tmp_path)).collect()}
    assert table[1].fields["N"] == "12" and not table[1].deleted and table[2].deleted and table[2].fields["NAME"] == "gone"


@pytest.mark.parametrize("order", ["<", ">"])
def test_geotiff_tags(spark, tmp_path, order):
    import struct

    scale, tie = struct.pack(order + "3d", 2.0, 3.0, 0.0), struct.pack(order + "6d", 0, 0, 0, 100.0, 500.0, 0)
    keys = struct.pack(order + "8H", 1, 1, 0, 1, 3072, 0, 1, 5186)
    nodata = b"-9999\0"
    blobs, at = [scale, tie, keys, nodata], 8 + 2 + 12 * 7 + 4
    places = []
    for b in blobs:
        places.append(at)
        at += len(b)
    short = lambda v: struct.pack(order + "HH", v, 0)
    entries = [(256, 3, 1, short(10)), (257, 3, 1, short(20)), (258, 3, 1, short(16)), (33550, 12, 3, struct.pack(order + "I", places[0])), (33922, 12, 6, struct.pack(order + "I", places[1])), (34735, 3, 8, struct.pack(order + "I", places[2])), (42113, 2, 6, struct.pack(order + "I", places[3]))]
    body = struct.pack(order + "H", 7) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + bytes(4)
    (tmp_path / "a.tif").write_bytes({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + body + b"".join(blobs))
    (tmp_path / "b.tif").write_bytes(b"no image")
    rows = files.geotiff(spark, str(tmp_path))
    r = rows.where("error is null").first()
    assert (r.width, r.height, r.bits, r.min_x, r.max_x, r.min_y, r.max_y, r.epsg, r.nodata) == (10, 20, 16, 100.0, 120.0, 440.0, 500.0, 5186, "-9999")
    assert rows.where("error like 'ValueError%'").count() == 1


@pytest.fixture
def small_splits(spark):
    """Splits of one kilobyte, so that lines and statements of every file lie in many."""
    keys = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_last_record_by_file_and_line(spark, tmp_path, small_splits):
    """A later file's record counts, though the later file is smaller or larger, and so does a later line in another split."""
    for folder, sizes in (("a", (20, 3000)), ("b", (3000, 20))):
        for k, n in enumerate(sizes):
            lines = [json.dumps({"k": f"k{i % 7}", "v": k * 10**6 + i}) for i in range(n)]
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / f"2026-0{k + 1}.jsonl").write_text("\n".join(lines))
        got = {r.k: r.v for r in files.last_per_key(spark, str(tmp_path / folder), "k string, v int", "k").collect()}
        assert got == {f"k{i}": 10**6 + max(j for j in range(sizes[1]) if j % 7 == i) for i in range(7)}


def test_statements_across_splits(spark, tmp_path, small_splits):
    """Quoted semicolons and quotes, statements longer than a split, an open string at the end of a file."""
    rng = random.Random(1)
    want = {}
    for name in ("a.ifc", "b.ifc"):
        body, own = ["ISO-10303-21;", "HEADER;FILE_DESCRIPTION(('x;y'),'2;1');", "DATA;"], {}
        for i in range(1, 300):
            text = "".join(rng.choice(["wall", "it''s", ";", "(", ")", ",", " ", "\n", "한"]) for _ in range(rng.randrange(12)))
            more = "," + ",".join(f"#{k}" for k in range(600)) if i % 100 == 0 else ""
            body.append(f"#{i} = IFCWALL('g{i}',#5,'{text}',$,({'#1' + more}));{' ' * rng.randrange(3)}")
            own[i] = text.replace("''", "'")
        (tmp_path / name).write_text("\n".join(body) + "\nENDSEC;\n#999=IFCDOOR('open; ('")
        want[name] = own
    rows = files.ifc(spark, str(tmp_path)).where("id < 999").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path.rsplit("/", 1)[1], {})[r.id] = r.name
    assert got == want and len(rows) == 598
    assert all(r.global_id == f"g{r.id}" and r.type == "IFCWALL" for r in rows)


def test_entity_of_a_megabyte(spark, tmp_path):
    """No regex recurses: many references, many quoted strings, deep brackets."""
    refs = ",".join(f"#{k}" for k in range(200_000))
    words = ",".join("'it''s; '" for _ in range(100_000))
    text = f"DATA;\n#1=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,'n; (',$,({refs}),#2);\n#3=IFCPROPERTYLIST('p',$,'long',({words}),((1,(2,3)),IFCLABEL('x)')));\nENDSEC;"
    entities = files.ifc(spark, put(tmp_path, "big.ifc", text))
    assert {(r.id, r.name) for r in entities.collect()} == {(1, "n; ("), (3, "long")}
    relations = files.ifc_relations(entities)
    assert relations.count() == 200_000 and {r.subject for r in relations.select("subject").distinct().collect()} == {2}
    got = entities.where("id = 3").select(F.size(statements.arguments(F.col("e"))).alias("n"), F.element_at(statements.arguments(F.col("e")), 5).alias("last")).first()
    assert got.n == 5 and got.last == "((1,(2,3)),IFCLABEL('x)'))"


def test_quoted_semicolons_are_no_records(spark, tmp_path, monkeypatch):
    """Only `);` in a string cuts a statement; ends of any form, a cut file and a byte order mark are read as they stand."""
    marks, shared = {}, statements.shared
    monkeypatch.setattr(statements, "shared", lambda df, name: marks.setdefault(name, shared(df, name)))
    long = "'" + "'';x" * 5000 + "'"
    want = ["ISO", "#1=A('x;);y);')", f"#2=B({long})", "#3=C('z' )", "ENDSEC"]
    for name, tail in (("a", ";"), ("b", ";\r\n#4=D('e',$"), ("c", ";#5=E('open;);("), ("d", ";#6=F();")):
        marks.clear()
        path = put(tmp_path, f"{name}.ifc", ("\ufeff" if name in "bd" else "") + ";\r\n".join(want[:3]) + " ; ;" + ";".join(want[3:]) + tail)
        got = [r.value.removeprefix("\ufeff") for r in statements.statements(spark, path).orderBy("block", "at", "nth").collect()]
        assert got == want + ([tail.strip(";\r\n")] if len(tail) > 1 else [])
        assert marks["blocks"].agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] < 10 and marks["marks"].count() < 10


def test_files_are_written_by_many_tasks(spark):
    """One task does not write all files: a table of one partition gives files of several tasks."""
    from draftlake.plans.readers import stored

    path = stored(spark.range(40).coalesce(1), "id", F.lit("x"))
    names = [r.p.rsplit("/", 1)[-1].split("-")[1] for r in files.binary(spark, path).select(F.col("path").alias("p")).collect()]
    assert len(names) == 40 and len(set(names)) > 4
