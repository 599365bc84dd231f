"""Questions, drawings read in full, evaluation and bounded neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.operators import ask, evaluation, graph, routing, rules, search
from draftlake.sources import files


@pytest.mark.parametrize(
    ("question", "kinds"),
    [("이 보에 쓰인 단면", ["Beam"]), ("정보 보고서", []), ("문은 몇 개", ["Door"]), ("문서 목록", []), ("Window와 벽체", ["Window", "Wall"])],
)
def test_short_words_need_their_ends(spark, question, kinds):
    assert spark.range(1).select(routing.kinds(F.lit(question)).alias("k")).first().k == kinds


def test_a_null_question_has_no_intents(spark):
    row = spark.range(1).select(routing.linked(F.lit(None).cast("string")).alias("l")).first().l
    assert row.intents == []


def test_answers_refuse_what_is_out_of_scope(spark):
    nodes = spark.createDataFrame([("d1", "Drawing", "2층 평면도", "Drawing 2층 평면도", "p")], "id string, type string, name string, search_text string, project_key string")
    got = {r.question: r.answer for r in ask.answer(nodes, ["오늘 날씨 어때?", "2층 평면도 도면을 찾아줘"]).collect()}
    assert got["오늘 날씨 어때?"] == "no evidence" and "평면도" in got["2층 평면도 도면을 찾아줘"]


def test_rule_evidence_names_source_and_token(spark):
    rows = [("INSERT", "0", "DOOR_900", None), ("INSERT", "0", "X", "furniture"), ("LINE", "A-WALL", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "entity_type string, layer string, block string, attributes string")
    got = [r.evidence for r in rules.classified(df).collect()]
    assert got[:3] == ["block: door", "attribute: furniture", "layer: a-wal"] and len(got) == 4


def drawing() -> str:
    """Pairs of lines: a layer table, a block definition, a polyline, an insert with an attribute, a line."""
    pairs = "0 SECTION 2 TABLES 0 LAYER 2 A-WALL 62 -3 0 ENDSEC 0 SECTION 2 BLOCKS 0 BLOCK 2 DOOR 0 LINE 10 0 20 0 11 1 21 1 0 INSERT 2 KNOB 0 ENDBLK 0 ENDSEC "
    pairs += "0 SECTION 2 ENTITIES 0 POLYLINE 5 A1 0 VERTEX 10 1 20 2 0 VERTEX 10 3 20 4 0 SEQEND 0 INSERT 5 A2 2 TITLE 10 0 20 0 0 ATTRIB 2 DWG_NO 1 A-101 0 SEQEND 0 LINE 5 A3 10 0 20 0 11 9 21 9 0 ENDSEC"
    return "\n".join(pairs.split())


def test_drawing_with_blocks_layers_and_attributes(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(drawing())
    (tmp_path / "torn.dxf").write_text("0\nSECTION\nx\ny")
    rows = {r.handle: r for r in files.dxf(spark, str(tmp_path)).collect()}
    assert rows["A1"].points == [[1.0, 2.0], [3.0, 4.0]] and rows["A2"].attributes == {"DWG_NO": "A-101"} and rows["A3"].max_x == 9.0
    assert rows[None].error.startswith("ValueError")
    assert [(r.name, r.entities, r.inserts) for r in files.dxf_blocks(spark, str(tmp_path)).collect()] == [("DOOR", 2, ["KNOB"])]
    assert [(r.name, r.color) for r in files.dxf_layers(spark, str(tmp_path)).collect()] == [("A-WALL", -3)]


def test_neighbourhood_is_limited_across_hops(spark):
    rows = [("e1", "r", "contains", "a"), ("e2", "r", "near", "b"), ("e3", "b", "contains", "c"), ("e4", "d", "near", "b"), ("e5", "x", "near", "y")]
    edges = spark.createDataFrame(rows, "id string, src string, predicate string, dst string")
    got = lambda hops, most: sorted((r.hop, r.id) for r in graph.neighbourhood(edges, "r", hops, most).collect())
    assert got(2, 10) == [(1, "e1"), (1, "e2"), (2, "e4")]  # a container found on the way does not spread
    assert got(2, 2) == [(1, "e1"), (1, "e2")] and got(1, 1) == [(1, "e2")] and got(2, 0) == []
    assert graph.neighbourhood(edges, "nowhere", 2, 5).count() == 0


def test_retrieval_metrics_by_case(spark):
    rows = [("q", 1, "z", "s1", "r1", "x", True), ("q", 2, "a", "s1", "r0", "x", False), ("q", 3, "b", "s9", "r1", "y", True), ("q", 6, "c", "s1", "r1", "w", True)]
    hits = spark.createDataFrame(rows, "case_id string, rank int, canonical_id string, source_id string, revision_id string, external_id string, provenance boolean")
    expected = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "case_id string, canonical_id string")
    allowed = spark.createDataFrame([("s1",)], "source_id string")
    current = spark.createDataFrame([("s1", "r1"), ("s9", "r1")], "source_id string, revision_id string")
    r = evaluation.retrieval_metrics(hits, expected, allowed, current, 5).first()
    assert (r.hits, round(r.recall, 4), r.reciprocal_rank, r.unauthorized, r.stale, r.duplicates, round(r.coverage, 4)) == (3, 0.6667, 0.5, 1, 1, 1, 0.6667)


def test_pack_drawings_rank_by_likeness(spark):
    names = ["A동 지상2층 소방설비 평면도", "A동지상2층소방설비평면도", "B동 지상3층 전기설비 평면도", "도면 목록"]
    df = spark.createDataFrame([(n, n) for n in names], "name string, body string")
    asked = spark.createDataFrame([(1, "A동 지상2층 소방설비"), (2, "?"), (3, "소방설비, 평면도?")], "question_id int, question string")
    rows = search.pack_drawings(df, "name", "body", asked).orderBy("question_id", F.desc("score"), "name").collect()
    first = [r.name for r in rows if r.question_id == 1]
    assert first[0] in names[:2] and "도면 목록" not in first
    assert not [r for r in rows if r.question_id == 2] and [r for r in rows if r.question_id == 3]


def words_of(text):
    import re

    return [[f"  {w} "[k : k + 3] for k in range(len(w) + 1)] for w in re.findall("[0-9a-z가-힣]+", text.lower())]


def best_extent(query, text):
    """The measure by its definition: every extent of the text's trigrams."""
    wanted, sequence = {g for w in words_of(query) for g in w}, [g for w in words_of(text) for g in w]
    best = 0.0
    for a in range(len(sequence)):
        for z in range(a + 1, len(sequence) + 1):
            own = set(sequence[a:z])
            best = max(best, len(own & wanted) / len(own | wanted))
    return best


def test_fuzzy_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    made = lambda n: " ".join("".join(rng.choice("abc층") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    texts, queries = [made(rng.randrange(0, 6)) for _ in range(80)] + ["", "?!"], [made(rng.randrange(0, 3)) for _ in range(30)]
    index = search.gram_index(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "id", "body")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for least in (0.05, 0.3, 0.6, 1.0):
        got = {(r.query_id, r.id): round(r.similarity, 9) for r in search.fuzzy_join(asked, index, "id", least).collect()}
        want = {(q, k): round(v, 9) for q, a in enumerate(queries) for k, b in enumerate(texts) if (v := best_extent(a, b)) >= least}
        assert got == want and len(got) == len({*got})


def test_knn_batch_equals_brute_force(spark):
    v = np.random.default_rng(0).integers(-2, 3, (300, 6)).astype(float)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    got = {}
    for r in search.knn_batch(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), rows, 7, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    s = v @ v.T
    for q in range(0, 300, 50):
        want = sorted((-s[q, i], i) for i in range(300) if i != q)[:7]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_equal_texts_are_read_once(spark):
    from draftlake.plans.questions import of_texts

    own = spark.createDataFrame([(k, None if k % 3 == 2 else f"q{k % 3}") for k in range(60)], "k long, q string")
    rows = of_texts(own, ["q"], made=F.rand(), again=F.col("made") + 1).collect()
    assert len(rows) == 60 and len({r.made for r in rows}) == 3 and all(r.again == r.made + 1 for r in rows)
