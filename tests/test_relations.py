"""Spatial relations, object constructors, question parsing and retrieval on hand-made sheets."""

import random

from pyspark.sql import functions as F

from draftlake.operators import ask, joins, relations as rel
from draftlake.sources import files

WALL = "sheet string, id string, idx long, points array<struct<x:double,y:double>>, closed boolean"
POINT = "sheet string, id string, idx long, x double, y double"


def test_hosts_and_contents(spark):
    walls = spark.createDataFrame([("S", "w1", 0, [(0.0, 0.0), (10.0, 0.0)], False), ("S", "w2", 1, [(5.0, 0.0), (5.0, 10.0)], False), ("T", "w3", 0, [(0.0, 1.0), (9.0, 1.0)], False)], WALL)
    segments = rel.segments(walls)
    openings = spark.createDataFrame([("S", "d1", 0, 2.0, 0.2), ("S", "d2", 1, 5.0, 0.0), ("S", "d3", 2, 50.0, 50.0)], POINT)
    got = {r.subject: (r.object, r.confidence) for r in rel.hosted(openings, segments, 1.0).collect()}
    assert got == {"d1": ("w1", 0.84), "d2": ("w1", 0.9)}
    spaces = spark.createDataFrame([("S", "left", 0, 2.0, 5.0), ("S", "right", 1, 8.0, 5.0)], POINT)
    rings = spark.createDataFrame([("S", "big", [(0.0, 0.0), (5.0, 0.0), (5.0, 10.0), (0.0, 10.0)]), ("S", "huge", [(-9.0, -9.0), (5.0, -9.0), (5.0, 20.0), (-9.0, 20.0)])], "sheet string, id string, ring array<struct<x:double,y:double>>")
    regions = rel.room_regions(spaces, rings)
    assert [(r.space, len(r.ring), r.ring[0].x) for r in regions.collect()] == [("left", 4, 0.0)]
    elements = spark.createDataFrame([("S", "e1", 0, 1.0, 1.0), ("S", "e2", 1, 7.0, 5.0), ("S", "e3", 2, 6.0, 5.0)], POINT)
    got = {r.object: (r.subject, r.method) for r in rel.contents(elements, spaces, regions, segments).collect()}
    assert got["e1"] == ("left", "point_in_room_boundary") and got["e2"][0] == "right" and got["e3"] == ("right", "nearest_room_label_without_wall_crossing")


def test_greedy_area_labels(spark):
    spaces = spark.createDataFrame([("S", "a", 0, 0.0, 10.0), ("S", "b", 1, 1.0, 10.0), ("S", "c", 2, 90.0, 10.0)], POINT)
    labels = spark.createDataFrame([("S", "t1", 12.5, 0.5, 9.0), ("S", "t2", 7.0, 2.0, 8.0), ("S", "t3", 0.0, 90.0, 9.0)], "sheet string, id string, value double, x double, y double")
    assert {tuple(r) for r in rel.area_labels(spaces, labels, 3.0).collect()} == {("t1", "a", 12.5), ("t2", "b", 7.0)}


def test_area_labels_of_shared_points(spark, monkeypatch):
    """Rooms and labels that share points, pools that run dry, equal costs: as by turns, in a few rounds."""
    rng = random.Random(6)
    spots = [(5.0, 9.0), (5.0, 9.0), (5.0, 9.0), (6.0, 9.0), (11.0, 12.0)]
    rooms = [("S", k, k, *rng.choice(spots)) for k in range(60)]
    labels = [("S", k, float(k % 4), *rng.choice([(4.0, 2.0), (0.0, 4.0), (10.0, 4.0), (5.0, 8.0), (12.0, 5.0)])) for k in range(50)]  # the first three are at equal costs of the first spot
    used, want = set(), set()
    for _, room, _, x, y in rooms:
        free = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, label, value) for _, label, value, u, v in labels if label not in used and 0 < y - v <= 8 and abs(x - u) <= 8]
        if free:
            used.add(min(free)[1])
            want |= {(min(free)[1], room, min(free)[2])} if min(free)[2] > 0 else set()
    schema = "sheet string, id int, idx int, x double, y double"
    assert {tuple(r) for r in rel.area_labels(spark.createDataFrame(rooms, schema), spark.createDataFrame(labels, "sheet string, id int, value double, x double, y double"), 8.0).collect()} == want
    written, shared = [], rel.shared
    monkeypatch.setattr(rel, "shared", lambda df, name: written.append(name) or shared(df, name))
    alone = spark.createDataFrame([("S", k, k, 5.0, 9.0) for k in range(60)], schema)
    texts = spark.createDataFrame([("S", k, 1.0, 5.0, 8.0 - k % 2) for k in range(100)], "sheet string, id int, value double, x double, y double")
    got = {(r.space, r.label) for r in rel.area_labels(alone, texts, 8.0).collect()}
    assert got == {(k, 2 * k if k < 50 else 2 * k - 99) for k in range(60)} and len(written) < 8


def test_profiles_and_walls(spark):
    profiles = spark.createDataFrame([("S", "p1", 0.0, 0.0, 2.0, 2.0), ("S", "p2", 50.0, 50.0, 52.0, 52.0)], "sheet string, id string, min_x double, min_y double, max_x double, max_y double")
    labels = spark.createDataFrame([("S", "l1", "H-2x2", 3.0, 3.0)], "sheet string, id string, designation string, x double, y double")
    assert {(r.id, r.designation, r.type) for r in rel.profile_labels(profiles, labels, 4.0).collect()} == {("p1", "H-2x2", "SteelSection"), ("p2", None, "BuildingElementProxy")}
    faces = spark.createDataFrame([("S", 1, 0.0, 0.0, 100.0, 0.0), ("S", 2, 10.0, 2.0, 90.0, 2.0), ("S", 3, 0.0, 30.0, 100.0, 30.0), ("S", 4, 0.0, 0.0, 0.0, 9.0)], "sheet string, id int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.id, r.other, round(r.gap, 6)) for r in rel.wall_pairs(faces, 1.0, 5.0).collect()] == [(1, 2, 2.0)]


def test_greedy_match_equals_the_order_of_takers(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(t, rng.randrange(10), i, float(rng.randrange(6))) for t in range(30) for i in rng.sample(range(25), rng.randrange(6))]
        place = {t: p for t, p, _, _ in reversed(pairs)}
        pairs = [(t, place[t] * 100 + t, i, c) for t, _, i, c in pairs]
        used, want = set(), set()
        for t in sorted(place, key=lambda t: place[t] * 100 + t):
            free = [(c, i) for u, _, i, c in pairs if u == t and i not in used]
            if free:
                c, i = min(free)
                used.add(i)
                want.add((t, i, c))
        got = rel.one_use(spark.createDataFrame(pairs, "taker int, place int, item int, cost double")).collect()
        assert {tuple(r) for r in got} == want
    assert rel.one_use(spark.createDataFrame([], "taker int, place int, item int, cost double")).count() == 0


def test_boxes_of_any_size_meet_in_few_cells(spark):
    rng = random.Random(4)

    def boxes(n):
        out = []
        for k in range(n):
            w, h = 10 ** rng.uniform(-1, 4), 10 ** rng.uniform(-1, 4)
            x, y = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)
            out.append((k, rng.randrange(2), x, y, x + w * (rng.random() > 0.1), y + h))
        return out

    a, b = boxes(150), boxes(150)
    schema = "id int, sheet int, min_x double, min_y double, max_x double, max_y double"
    p, q = (spark.createDataFrame(x, schema) for x in (a, b))
    want = {(r[0], s[0]) for r in a for s in b if r[1] == s[1] and r[2] <= s[4] and s[2] <= r[4] and r[3] <= s[5] and s[3] <= r[5]}
    rows = joins.overlapping(p, q, 5.0, ("sheet",)).collect()
    assert {(r.id, r.b_id) for r in rows} == want and len(rows) == len(want)
    one = spark.createDataFrame([(0, 0, 0.0, 0.0, 1e9, 1e9)], schema)
    assert joins.placed(one, 1.0, one, (0, 1), 2).count() <= 2 * 4  # a continent in a grid of ones
    assert joins.overlapping(p, q.limit(0), 5.0).count() == 0


def cross(a, b, c, d):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def test_sights_equal_brute_force(spark):
    rng = random.Random(5)
    at = lambda: (float(rng.randrange(100)), float(rng.randrange(60)))
    walls = [(s, *at(), *at()) for s in range(3) for _ in range(12)] + [(0, 5.0, 5.0, 5.0, 5.0)]
    elements = [(s, 100 * s + k, *at()) for s in range(4) for k in range(25)]
    rooms = [(s, 100 * s + k, *at()) for s in range(4) for k in range(12)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = rel.nearest_in_sight(make(elements, "sheet int, id int, x double, y double"), make(rooms, "sheet int, id int, x double, y double"), make(walls, "sheet int, x1 double, y1 double, x2 double, y2 double")).collect()
    want = {}
    for s, e, x, y in elements:
        seen = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, r) for t, r, u, v in rooms if t == s and not any(w[0] == s and cross((x, y), (u, v), w[1:3], w[3:5]) for w in walls)]
        if seen:
            want[e] = min(seen)[1]
    assert {r.id: r.space for r in got} == want and len(got) == len(want)


def test_sheets_with_and_without_a_grid(spark):
    """Sheets of few walls are one cell, those of many have grids: hosts and sights as by brute force, whatever the bound."""
    rng = random.Random(8)
    at = lambda: (float(rng.randrange(100)), float(rng.randrange(60)))
    walls = [(s, k, k, *at(), *at()) for s, n in ((0, 14), (1, 2), (2, 5)) for k in range(100 * s, 100 * s + n)]
    points = [(s, 100 * s + k, *at()) for s in range(4) for k in range(30)]
    rooms = [(s, 100 * s + k, *at()) for s in range(4) for k in range(9)]

    def distance(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / n)) if n else 0.0
        return ((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) ** 0.5

    hosts, sights = {}, {}
    for s, e, x, y in points:
        near = [(distance(x, y, *w[3:]), w[1]) for w in walls if w[0] == s]
        hosts |= {str(e): str(min(near)[1])} if near and min(near)[0] <= 6 else {}
        seen = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, r) for t, r, u, v in rooms if t == s and not any(w[0] == s and cross((x, y), (u, v), w[3:5], w[5:7]) for w in walls)]
        sights |= {e: min(seen)[1]} if seen else {}
    w = spark.createDataFrame(walls, "sheet int, id int, idx int, x1 double, y1 double, x2 double, y2 double")
    p, r = (spark.createDataFrame(x, "sheet int, id int, x double, y double") for x in (points, rooms))
    for most in (0, 4, 512):
        assert sorted((str(f.subject), str(f.object)) for f in rel.hosted(p, w, 6.0, most=most).collect()) == sorted(hosts.items())
        assert sorted((f.id, f.space) for f in rel.nearest_in_sight(p, r, w, most=most).collect()) == sorted(sights.items())


def test_rings_are_told_by_their_corners_first(spark):
    """Points on, in and around rings that lean or are level: regions and contents as by ray parity alone."""
    rng = random.Random(9)
    at = lambda: (float(rng.randrange(12)), float(rng.randrange(12)))
    rings = [(0, k, [at() for _ in range(rng.randrange(3, 7))]) for k in range(40)]
    points = [(0, 100 * x + y, 0, float(x), float(y)) for x in range(-1, 13) for y in range(-1, 13)]
    r = spark.createDataFrame(rings, "sheet int, id int, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame(points, "sheet int, id int, idx int, x double, y double")
    pairs = p.join(r.withColumnRenamed("id", "ring_id"), "sheet")
    here = rel.cornered(pairs).where(rel.around(F.col("ring"), F.col("x"), F.col("y"), F.col("low"), F.col("high")))
    plain = pairs.where(rel.spatial.in_ring(F.col("ring"), F.col("x"), F.col("y")))
    got, want = (sorted(map(tuple, x.select("id", "ring_id").collect())) for x in (here, plain))
    assert got == want and len(want) > 100


def test_titles_are_read_once_a_sheet(spark, monkeypatch):
    """Sheets that are derived from walls come down to one row before titles are read; a small sheet's walls stay one row each."""
    rows, shared = {}, rel.shared

    def counted(df, name):
        out = shared(df, name)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(rel, "shared", counted)
    rng = random.Random(10)
    at = lambda: (float(rng.randrange(900)), float(rng.randrange(900)))
    walls = spark.createDataFrame([(k % 3, k, k, *at(), *at()) for k in range(300)], "sheet int, id int, idx int, x1 double, y1 double, x2 double, y2 double")
    spaces = spark.createDataFrame([(s, 10 * s + k, *at()) for s in range(3) for k in range(4)], "sheet int, id int, x double, y double")
    sheets = walls.select("sheet").distinct().select("sheet", F.lit("P").alias("project"), F.lit("").alias("number"), F.concat(F.col("sheet") + 1, F.lit("층 평면도")).alias("title"), F.lit("plan").alias("category"))
    got = {(r.subject, r.object) for r in rel.sheet_relations(sheets, spaces).where("predicate = 'hasSpace'").collect()}
    assert got == {(f"storey:{s + 1}F", str(10 * s + k)) for s in range(3) for k in range(4)} and rows["sheets"] == 3
    rel.nearest_in_sight(spaces, spaces, walls)
    assert rows["walls"] == 300


def test_sheets_and_objects(spark, tmp_path):
    sheets = spark.createDataFrame([("S", "P", "A-101", "3층 평면도", "plan"), ("T", "P", None, "3층 상세", "detail")], "sheet string, project string, number string, title string, category string")
    blocks = spark.createDataFrame([("S", "b2", 5), ("S", "b1", 3)], "sheet string, id string, idx int")
    spaces = spark.createDataFrame([("S", "r1"), ("T", "r2")], "sheet string, id string")
    got = {(r.subject, r.predicate, r.object) for r in rel.sheet_relations(sheets, spaces, blocks).collect()}
    project, storey = "aec://project/P", "storey:3F"
    assert got == {(project, "containsElement", "sheet:A-101"), (project, "containsElement", "sheet:T"), (project, "containsElement", storey), ("sheet:A-101", "depicts", storey), ("sheet:A-101", "depicts", "r1"), ("sheet:T", "depicts", "r2"), (storey, "hasSpace", "r1"), ("r1", "onStorey", storey), ("sheet:A-101", "hasTitleBlock", "b1")}
    path = tmp_path / "h.ifc"
    path.write_text("DATA;\n#1=IFCWALL('g',$,'W',$);\n#2=IFCPIPE('p',$,$,$);\n#3=IFCRELAGGREGATES('r',$,$,$,#1,(#2));\nENDSEC;")
    assert {(r.entity_id, r.type, r.confidence) for r in rel.ifc_objects(files.ifc(spark, str(path)), "P").collect()} == {(1, "Wall", 1.0), (2, "IFCEntity", 0.65)}
    site = tmp_path / "s.geojson"
    site.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"kind":"Building"},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert {(r.feature_id, r.type) for r in rel.gis_objects(files.geojson(spark, str(site))).collect()} == {("0", "Building"), ("1", "GISFeature")}
    tags = spark.createDataFrame([(1, 0, "DWG NO", "A-1"), (1, 1, "title", "Plan"), (1, 2, "X", "1"), (1, 3, "X", "2"), (2, 0, "SCALE", "1/50")], "id int, pos int, tag string, value string")
    got = {r.id: (r.attributes, r.block) for r in rel.attribute_map(tags).withColumn("block", rel.title_block(F.col("attributes"))).collect()}
    assert got[1][0]["X#2"] == "2" and (got[1][1].drawingNumber, got[1][1].drawingTitle) == ("A-1", "Plan") and got[2][1] is None


def test_questions(spark):
    assert ask.parse("3층 방 목록 h형강") == ask.Parsed(["H-", "형강"], "3F", "Space")
    assert ask.parse("지하1층 계단") == ask.Parsed(["계단"], "B1", None)
    assert ask.translate("stairs on the 3rd floor of fire door A-101?", {"fire door": "방화문", "stairs": "계단"}) == "계단 3F 방화문 A-101"
    nodes = spark.createDataFrame(
        [("1", "Space", "회의실", "회의실 3층", "P"), ("2", "Space", "창고", "창고 1층", "P"), ("3", "Drawing", "plan A", "plan A 회의실", "P"), ("4", "Section", "H-1", "H-100x50 steel", "P")],
        "id string, type string, name string, search_text string, project_key string",
    )
    got = ask.retrieve(nodes, "회의실 room", "graph:room").collect()
    assert [(r.id, r.leg) for r in got] == [("1", 0), ("3", 1)]
    answers = {r.question: r.answer for r in ask.answer(nodes, ["steel section h-100x50", "zebra"]).collect()}
    assert answers["steel section h-100x50"].startswith("[4] H-1") and answers["zebra"] == "no evidence"
