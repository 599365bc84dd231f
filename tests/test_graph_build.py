"""The knowledge graph from small document parts: evidence limits, fallbacks of storeys, series, odd rows, communities."""

import json

import pytest

from draftlake.operators import graph_build, knowledge

SCHEMAS = {
    "documents": "document_id long, project_key string, project_name string, phase string, name string, number string, title string, series string, date string, mtime string, discipline string",
    "sheets": "id long, document_id long, number string, title string, layout string, label string, scale string, category string, storey string",
    "spaces": "id long, document_id long, room string, number string, area double, storey string",
    "elements": "id long, document_id long, kind string, state string",
    "sections": "id long, document_id long, designation string",
    "members": "document_id long, kind string, section long",
}


def made_parts(spark):
    rows = {
        "documents": [
            (1, "p", "House", "허가", "2층 평면도.dwg", "A-101", "평면도", "no:A-101", "240101", None, "ARCH"),
            (2, "p", "House", "", "A-101 old.dwg", "A-101", None, "no:A-101", None, "2023", None),
            (3, "q", "Barn", None, "x.DXF", None, None, "t:x", None, None, "STRUCT"),
        ],
        "sheets": [(10, 1, "S-1", "Block", "L1", "label", None, "plan", None), (11, 3, None, None, None, "label", None, "기타", "B1"), (12, 99, "S-9", None, "L", "l", None, None, "1F")],
        "spaces": [(20, 1, " Living  Room ", "101", 12.5, None), (21, 1, "living room", "102", None, "3층"), (22, 1, "LIVINGROOM", None, 3.0, None), (23, 3, " - ", None, None, None), (24, 3, None, None, None, None)],
        "elements": [(100 + k, 1, "Door", "OBSERVED" if k % 2 else "AI_INFERRED") for k in range(25)] + [(200, 3, "Thing", None), (201, 2, "Wall", None)],
        "sections": [(30, 3, "H 300*150"), (31, 3, "h-300x150"), (32, 3, None), (33, 1, "odd")],
        "members": [(1, "Door", 30), (3, "Wall", 30), (1, "Door", 33)],
    }
    return graph_build.Parts(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})


@pytest.fixture(scope="module")
def built(spark):
    made = graph_build.build(made_parts(spark))
    return made, {r.id: r for r in made.nodes.collect()}, {(r.src, r.predicate, r.dst): r.props for r in made.edges.collect()}


def test_facts_tell_the_same_as_nodes(built, spark):
    """Communities of the facts, which have no evidence, are those of the whole graph."""
    made, _, _ = built
    told = graph_build.build(made_parts(spark), ("facts",))
    assert told.nodes is None and told.aliases is None and {r.predicate for r in told.edges.collect()} == {"depictsStorey"}
    plan = told.facts._jdf.queryExecution().analyzed().toString()
    assert "dense_rank" not in plan and "object_ids" not in plan
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    assert shown(knowledge.communities(told.facts, told.edges)) == shown(knowledge.communities(made.nodes, made.edges))


def test_evidence_of_repeated_rows(spark):
    """The first distinct items, by one shuffle of the rows."""
    rows = spark.createDataFrame([("a", k // 3) for k in range(90)] + [("b", None), ("c", 7)], "g string, id int")
    found = graph_build.evidence(rows, ["g"], "id", "ids")
    assert {r.g: list(r.ids) for r in found.collect()} == {"a": list(range(20)), "c": [7]}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_nodes(built):
    made, nodes, edges = built
    assert made.nodes.count() == len(nodes) and made.edges.count() == len(edges)
    assert {s for s, _, _ in edges} | {d for _, _, d in edges} <= set(nodes)
    by_type = {}
    for r in nodes.values():
        by_type.setdefault(r.type, []).append(r)
    assert {k: len(v) for k, v in by_type.items()} == {"Project": 2, "Phase": 1, "Drawing": 3, "DrawingSeries": 1, "Sheet": 2, "Storey": 3, "Space": 2, "ElementGroup": 2, "SteelSection": 2}
    doors = nodes["kg:eg:1:Door"]
    props = json.loads(doors.props)
    assert (props["count"], props["observed"], props["storey"], props["kind_ko"]) == (25, 12, "2F", "문")
    assert doors.object_ids == [str(100 + k) for k in range(20)]
    rooms = {json.loads(r.props)["storey"]: json.loads(r.props) for r in by_type["Space"]}
    assert rooms["2F"]["occurrences"] == 2 and rooms["2F"]["areas"] == [12.5, 3.0] and rooms["2F"]["room_numbers"] == ["101"]  # the drawing shows one storey
    assert rooms["3F"]["occurrences"] == 1
    steel = json.loads(nodes["kg:sec:q:H-300x150"].props)
    assert steel["occurrences"] == 2 and steel["member_kinds"] == {"Door": 1}
    drawing = json.loads(nodes["kg:d:1"].props)
    assert drawing["sheet_number_titleblock"] == "S-1" and drawing["series_latest"] is True and drawing["element_counts"] == {"Door": 25} and drawing["categories"] == ["plan"]
    assert json.loads(nodes["kg:p:p"].props)["disciplines"] == {"ARCH": 1, "UNKNOWN": 1}
    assert "건축" in nodes["kg:d:1"].search_text and nodes["kg:sh:10"].name == "S-1 Block" and nodes["kg:sh:11"].name == "label"


def test_edges_and_aliases(built):
    made, nodes, edges = built
    series = next(i for i in nodes if i.startswith("kg:ser:"))
    assert edges["kg:d:1", "supersedes", "kg:d:2"] == '{"by":"date"}'
    assert (edges[series, "hasRevision", "kg:d:2"], edges[series, "hasRevision", "kg:d:1"]) == ('{"order":0}', '{"order":1}')
    assert ("kg:d:1", "depictsStorey", "kg:st:p:2F") in edges and ("kg:sh:11", "depictsStorey", "kg:st:q:B1") in edges
    assert ("kg:st:p:2F", "hasElements", "kg:eg:1:Door") in edges and ("kg:p:q", "usesSection", "kg:sec:q:H-300x150") in edges
    aliases = {(r.alias_type, r.alias, r.node_id) for r in made.aliases.collect()}
    assert ("section", "H 300*150", "kg:sec:q:H-300x150") in aliases and ("sheet_number", "A-101", "kg:d:2") in aliases
    assert {a for t, a, _ in aliases if t == "room_name"} == {" Living  Room ", "living room", "LIVINGROOM"}


def test_communities_of_the_graph(built, spark):
    made, _, _ = built
    pack = spark.createDataFrame([("kg:p:k", "k", "Project", "Kit", '{"pack":true}'), ("b1", "k", "Block", "Bolt", '{"description":"M12"}'), ("b2", "k", "Block", "Nut", "{}")], "id string, project_key string, type string, name string, props string")
    nodes = made.nodes.select("id", "project_key", "type", "name", "props").unionByName(pack)
    got = {r.id: r for r in knowledge.communities(nodes, made.edges).collect()}
    assert {"kgc:p:0", "kgc:q:0", "kgc:k:0", "kgc:p:1:storey:2F", "kgc:p:1:storey:3F", "kgc:q:1:storey:B1", "kgc:p:1:steel", "kgc:q:1:steel", "kgc:k:1:type:Block"} == set(got)
    assert got["kgc:k:1:type:Block"].facts == ["프로젝트: Kit", "Block 2건", "Bolt: M12", "Nut"]
    assert got["kgc:q:1:steel"].facts == ["프로젝트: Barn", "철골 단면 1종", "단면 H-300x150: 표기 2회, 부재 문 1"]
    assert "요소 수(후보 포함): 문 25" in got["kgc:p:1:storey:2F"].facts and got["kgc:p:1:storey:2F"].members == 3
    assert got["kgc:p:0"].facts[:2] == ["프로젝트: House", "도면 수: 2"] and len({r.input_hash for r in got.values()}) == len(got)


def test_empty_parts(spark):
    made = graph_build.build(graph_build.Parts(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}))
    assert made.nodes.count() == made.edges.count() == made.aliases.count() == 0


def test_only_wanted_tables_are_computed(spark):
    parts = graph_build.Parts(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})
    made = graph_build.build(parts, ("aliases",))
    assert made.nodes is None and made.edges is None
    assert "row_number" not in made.aliases._jdf.queryExecution().analyzed().toString()
