"""Table writers, packs, contracts and the command line."""

import json

from pyspark.sql import functions as F

from draftlake import cli
from draftlake.functions import text
from draftlake.operators import contracts, portable


def test_export_and_projection(spark, tmp_path):
    objects = spark.createDataFrame([("o1", "d1", "Wall"), ("o2", "d2", "Door")], "id string, document_id string, kind string")
    relations = spark.createDataFrame([("o1", "o2", "d1")], "subject string, object string, document_id string")
    assert portable.export({"objects": objects, "relations": relations}, str(tmp_path / "x")) == {"objects": 2, "relations": 1}
    body = spark.read.text(str(tmp_path / "x" / "manifest.json")).first().value
    assert json.loads(body)["rows"]["objects"] == 2
    assert spark.read.json(str(tmp_path / "x" / "objects.jsonl")).count() == 2
    portable.project_documents(objects, relations, str(tmp_path / "store"))
    again = objects.where("document_id = 'd1'").withColumn("kind", F.lit("Slab"))
    portable.project_documents(again, relations, str(tmp_path / "store"))
    got = {(r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "store" / "objects")).collect()}
    assert got == {("o1", "Slab"), ("o2", "Door")}


def test_pack(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "T", "n", "body"), ("2", "T", "m", None)], "id string, type string, name string, text string")
    edges = spark.createDataFrame([("1", "p", "2")], "src string, predicate string, dst string")
    names = spark.createDataFrame([("t", "a", "1")], "alias_type string, alias string, node_id string")
    n, e, a, c = portable.pack_tables(nodes, edges, names, "p")
    assert [(r.id, r.status) for r in c.collect()] == [("kc:1", "DONE")]
    portable.write_graph(n, e, a, str(tmp_path / "kg"))
    assert spark.read.parquet(str(tmp_path / "kg" / "nodes")).where("project_key = 'kb:p'").count() == 2


def test_contracts(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(contracts.report(F.encode(F.lit("x"), "UTF-8")))["fits"]
    assert first(F.try_variant_get(contracts.last_json(F.lit('a {"k": 1} {"k": 2}')), "$.k", "int")) == 2
    assert first(contracts.reused_hash(F.lit(1), F.lit(1), F.lit("h"), F.encode(F.lit("x"), "UTF-8"))) == "h"
    assert first(contracts.source_identity(F.lit("s"), F.lit("e"))).startswith("src_")
    scope = contracts.evidence_scope(spark.createDataFrame([("a", None, 1)], "x string, y string, v int"), spark.createDataFrame([("a", None)], "x string, y string"), ["x", "y"])
    assert scope.count() == 0


def test_names(spark):
    rows = spark.createDataFrame([("03_S-101~132 구조.dwg",), ("M-357 - [ 2층 덕트 평면도 ].dwg",), ("Xyz 12.dwg",)], "t string")
    got = [tuple(r.f) for r in rows.select(text.sheet_fields(F.col("t")).alias("f")).collect()]
    assert got == [("S-101", "구조"), ("M-357", "2층 덕트 평면도"), (None, "Xyz 12")]
    rows = spark.createDataFrame([("학장동 카페/#허가",), ("##캠핑장/도면",), ("###프로젝트/양산",), ("a/b",)], "t string")
    got = [tuple(r.f) for r in rows.select(text.project(F.col("t")).alias("f")).collect()]
    assert got == [("학장동-카페", "학장동 카페", "허가"), ("캠핑장", "캠핑장", "도면"), ("양산", "양산", ""), ("b", "b", "")]
    rows = spark.createDataFrame([("101호 회의실",), ("LIVING ROOM (24.3 m2)",), ("침실1\n12,5㎡",), ("3.5",), (None,)], "t string")
    got = [r.f and (r.f.number, r.f.name.strip(), r.f.area) for r in rows.select(text.room_label(F.col("t")).alias("f")).collect()]
    assert got == [("101", "회의실", None), (None, "LIVING ROOM", 24.3), (None, "침실1", 12.5), None, None]
    words = spark.createDataFrame([("방화문을 연다",), ("문을 연다",), ("문서",)], "t string")
    assert [r[0] for r in words.select(text.whole_word(F.col("t"), "문")).collect()] == [False, True, False]


def test_command_line(capsys):
    assert cli.main(["--list"]) == 0
    assert "memory_topk" in capsys.readouterr().out
    assert len({t["name"] for t in cli.tools()}) == len(cli.tools())
