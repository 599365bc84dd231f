"""Questions, rules and evaluation: fixed cases crossed with the driver's rows, with the answers stated literally."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators import ask, evaluation, graph, routing, rules, search
from draftlake.operators.tables import relations_table
from draftlake.plans.adapters import query
from draftlake.plans.text import EXTENT, GRAMS, SEQUENCE


def literal(value) -> str:
    if isinstance(value, float):
        return f"{value}::DOUBLE"
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """VALUES of (k, *row) under the alias v."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, (k, *r))) + ')' for k, r in enumerate(rows))}) v(k, {columns})"


def cases(t, spark, rows: list[tuple], schema: str, n: int) -> DataFrame:
    """Each part with the case of its number: a fixed table of n rows is broadcast."""
    known = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(rows)], f"k long, {schema}")
    return t("part").withColumn("k", F.col("p_partkey") % len(rows)).join(F.broadcast(known), "k")


#: Entity type, layer, block, attributes; label, confidence, method.
RULE_CASES = [
    ("LINE", "A-WALL", None, None, "Wall", 0.91, "hybrid_rules"),
    ("LINE", "S_STRS", None, None, "Stair", 0.87, "hybrid_rules"),
    ("INSERT", "0", "DOOR_900", None, "Door", 0.92, "hybrid_rules"),
    ("INSERT", "0", "AW", None, "Window", 0.88, "hybrid_rules"),
    ("TEXT", "A-DOOR", None, None, "Annotation", 0.78, "entity_type_rule"),
    ("LINE", "0", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "A-ELEV-OTLN", None, None, "Wall", 0.76, "layer_convention_rules"),
    ("LINE", "S-STL", None, None, "SteelSection", 0.76, "layer_convention_rules"),
    ("LINE", "GRND", None, None, "Annotation", 0.76, "layer_convention_rules"),
    ("HATCH", "A-PATT", None, None, "BuildingElementProxy", 0.6, "layer_convention_rules"),
    ("LINE", "WALL-DOOR", None, None, "Door", 0.9, "hybrid_rules"),
    ("LINE", "창고", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "창문", None, None, "Window", 0.9, "hybrid_rules"),
    ("LINE", "고정창", None, None, "Window", 0.9, "hybrid_rules"),
    ("LINE", "문서", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "자동문", None, None, "Door", 0.9, "hybrid_rules"),
    ("LINE", "큰보", None, None, "Beam", 0.88, "hybrid_rules"),
    ("LINE", "홍보", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "벽지", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "A_벽", None, None, "Wall", 0.91, "hybrid_rules"),
    ("LINE", "COL", None, None, "Column", 0.88, "hybrid_rules"),
    ("LINE", "COLOR", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "COLUMN", None, None, "Column", 0.88, "hybrid_rules"),
    ("LINE", "C1", None, None, "Column", 0.88, "hybrid_rules"),
    ("LINE", "TC-12", None, None, "Column", 0.88, "hybrid_rules"),
    ("LINE", "SD-1", None, None, "Door", 0.9, "hybrid_rules"),
    ("LINE", "SD1", None, None, "Door", 0.9, "hybrid_rules"),
    ("LINE", "FW12A", None, None, "Window", 0.9, "hybrid_rules"),
    ("LINE", "EV-2", None, None, "Elevator", 0.86, "hybrid_rules"),
    ("LINE", "LIFT", None, None, "Elevator", 0.86, "hybrid_rules"),
    ("INSERT", "0", "*U12", None, "CADEntity", 0.35, "fallback"),
    ("INSERT", "A-WALL", "*U12", None, "Wall", 0.91, "hybrid_rules"),
    ("INSERT", "0", "SD", None, "Door", 0.88, "hybrid_rules"),
    ("INSERT", "0", "d-special", None, "Door", 0.82, "hybrid_rules"),
    ("INSERT", "0", "w_special", None, "Window", 0.82, "hybrid_rules"),
    ("INSERT", "0", "X", "furniture", "Furniture", 0.86, "hybrid_rules"),
    ("INSERT", "S-BOLT", "X", None, "Bolt", 0.84, "hybrid_rules"),
    ("INSERT", "0", "변기", None, "Furniture", 0.88, "hybrid_rules"),
    ("INSERT", "0", "TOILET-1", None, "Furniture", 0.88, "hybrid_rules"),
    ("INSERT", "0", "EV1", None, "Elevator", 0.88, "hybrid_rules"),
    ("DIMENSION", "A-WALL", None, None, "Dimension", 0.82, "entity_type_rule"),
    ("ARC_DIMENSION", "0", None, None, "Dimension", 0.82, "entity_type_rule"),
    ("LEADER", "A-DOOR", None, None, "Annotation", 0.82, "entity_type_rule"),
    ("MULTILEADER", "0", None, None, "Annotation", 0.82, "entity_type_rule"),
    ("TOLERANCE", "0", None, None, "Annotation", 0.82, "entity_type_rule"),
    ("MTEXT", "계단", None, None, "Annotation", 0.78, "entity_type_rule"),
    ("ATTRIB", "A-DOOR", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "슬라브", None, None, "Slab", 0.86, "hybrid_rules"),
    ("LINE", "A-GRID", None, None, "Grid", 0.84, "hybrid_rules"),
    ("LINE", "중심선", None, None, "Grid", 0.84, "hybrid_rules"),
    ("LINE", "A-ANNO", None, None, "Annotation", 0.8, "hybrid_rules"),
    ("LINE", "SYMBOL", None, None, "Annotation", 0.8, "hybrid_rules"),
    ("LINE", "NORTH", None, None, "Annotation", 0.8, "hybrid_rules"),
    ("LINE", "방위", None, None, "Annotation", 0.8, "hybrid_rules"),
    ("LINE", "GIRDER", None, None, "Beam", 0.88, "hybrid_rules"),
    ("LINE", "PARTITION", None, None, "Wall", 0.91, "hybrid_rules"),
    ("LINE", "FLOOR", None, None, "Slab", 0.86, "hybrid_rules"),
    ("LINE", "ANCHOR", None, None, "Bolt", 0.84, "hybrid_rules"),
    ("LINE", "싱크", None, None, "Furniture", 0.86, "hybrid_rules"),
    ("LINE", "BED", None, None, "Furniture", 0.86, "hybrid_rules"),
    ("LINE", "BEDROOM", None, None, "CADEntity", 0.35, "fallback"),
    ("LINE", "MARKET", None, None, "CADEntity", 0.35, "fallback"),
    ("INSERT", "0", "A1_TITLE", None, "TitleBlock", 0.9, "attribute_rules"),
    ("INSERT", "도곽", "X", None, "TitleBlock", 0.9, "attribute_rules"),
    ("INSERT", "BORDER-LINE", "DOOR", None, "TitleBlock", 0.9, "attribute_rules"),
]
#: Question; route, intents, storeys, kinds, sections, sheets, rooms, refusal, asked attribute, memory route.
QUESTIONS = [
    ('학장동 카페 프로젝트 개요를 요약해줘', 'summary', 'summary', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('H-300x150x6.5x9 단면은 어느 도면에 쓰였나?', 'graph:section', 'location,drawing', '', '', 'H-300x150x6.5x9', '', '', '', '', 'GLOBAL_MEMORY'),
    ('A-101 도면은 무엇인가?', 'keyword:sheet', 'find_drawing,drawing', '', '', '', 'A-101', '', '', '', 'GLOBAL_MEMORY'),
    ('2층 실 목록 알려줘', 'graph:storey', 'list', '2F', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('2층에 문은 몇 개야?', 'graph:elements', 'count', '2F', 'Door', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('화장실은 어느 층에 있어?', 'graph:room', 'location', '', '', '', '', '화장실', '', '', 'GLOBAL_MEMORY'),
    ('배치도 최신 버전은?', 'graph:revision', 'revision,drawing', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('방수 상세 마감은 어떻게 되어 있나', 'semantic', '', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('옥상층평면도 관련 도면을 찾아줘', 'graph:drawings', 'find_drawing,drawing', 'RF', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('용도변경개요 관련 도면을 찾아줘', 'graph:drawings', 'summary,find_drawing,drawing', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('평면도 해치는 어떻게 그려?', 'knowledge', 'knowledge,drawing', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('leader style 버그 해결 방법', 'knowledge', 'knowledge', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('2층 문 몇 개야?', 'graph:elements', 'count', '2F', 'Door', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('이 보에 쓰인 단면', 'semantic', '', '', 'Beam', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('정보 보고서', 'semantic', '', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('문은 몇 개', 'graph:elements', 'count', '', 'Door', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('문서 목록', 'semantic', 'list', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('B1 층 H-300x150 단면', 'graph:section', '', 'B1', '', 'H-300x150', '', '', '', '', 'GLOBAL_MEMORY'),
    ('오늘 부산 날씨 어때?', 'semantic', '', '', '', '', '', '', 'not drawing data', '', 'GLOBAL_MEMORY'),
    ('주식 시장 전망을 알려줘', 'semantic', 'list', '', '', '', '', '', 'not drawing data', '', 'GLOBAL_MEMORY'),
    ('2층 회의실 면적이 얼마야?', 'graph:room', '', '2F', '', '', '', '회의실', '', '', 'STRUCTURED'),
    ('H-300x300 단면은 어느 도면에 쓰였어?', 'graph:section', 'location,drawing', '', '', 'H-300x300', '', '', '', '', 'GLOBAL_MEMORY'),
    ('학장동 카페 건축주의 전화번호를 알려줘', 'semantic', 'list', '', '', '', '', '', '', '전화번호', 'GLOBAL_MEMORY'),
    ('총 공사비는 얼마야?', 'semantic', '', '', '', '', '', '', 'no anchor', '공사비', 'GLOBAL_MEMORY'),
    ('계단실과 엘리베이터홀은 어디에 있나', 'graph:room', 'location', '', 'Elevator', '', '', '엘리베이터홀,계단실', '', '', 'GRAPH_PLUS_GEOMETRY'),
    ('Which door is on 3F?', 'graph:elements', '', '3F', 'Door', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('nearest room to the stair', 'semantic', '', '', 'Stair', '', '', '', '', '', 'KNOWLEDGE_GRAPH'),
    ('where is the lobby', 'semantic', '', '', '', '', '', '', 'no anchor', '', 'GRAPH_PLUS_GEOMETRY'),
    ('design concept of the hall', 'semantic', '', '', '', '', '', '', 'no anchor', '', 'VECTOR_PLUS_GRAPH'),
    ('floor area of the office', 'semantic', '', '', '', '', '', '', 'no anchor', '', 'STRUCTURED'),
    ('지하1층 주차장 도면 목록', 'graph:drawings', 'find_drawing,list,drawing', 'B1', '', '', '', '주차장', '', '', 'GLOBAL_MEMORY'),
    ('기둥 수량은 얼마나 많아', 'graph:elements', 'count', '', 'Column', '', '', '', '', '', 'GLOBAL_MEMORY'),
    ('소방-12 시트 보여줘', 'semantic', 'list,drawing', '', '', '', '', '', '', '', 'GLOBAL_MEMORY'),
]
#: Question, context; the asked attribute that the context does not support.
GATED = [
    ("학장동 카페 건축주의 전화번호를 알려줘", "프로젝트 학장동 카페 1F: 실 3개", "전화번호"),
    ("학장동 카페 건축주의 전화번호를 알려줘", "건축주 홍길동 TEL 051-123-4567", None),
    ("총 공사비는 얼마야?", "실 '회의실': 면적 12.5㎡", "공사비"),
    ("총 공사비는 얼마야?", "총 공사비 1,200 만원", None),
    ("회의실 면적이 얼마야?", "실 '회의실': 면적 12.5㎡", None),
    ("오늘 날씨", "날씨 맑음", "날씨"),
    ("이메일 주소", "mail a@b.kr", None),
    ("받은 상", "2020 award", None),
]
#: Word, with particle.
TOPICS = [("데크", "데크는"), ("화장실", "화장실은"), ("문", "문은"), ("A1", "A1은"), ("A2", "A2는"), ("level", "level는"), ("10", "10은"), ("창호", "창호는"), ("슬래브", "슬래브는"), ("기둥 ", "기둥 은")]
GLOSSARY = {"floor plan": "평면도", "door": "문", "window": "창문", "fire door": "방화문", "stair hall": "계단실"}
#: English question, its translation.
TRANSLATED = [
    ("the door on the 3rd floor", "문 3F"), ("fire door of the stair hall", "방화문 계단실"), ("floor plan of A-101", "평면도 A-101"), ("floor 2 window?", "2F 창문"), ("windows", "windows"),
]
#: Block, layer, attribute fields; evidence.
TITLE_CASES = [
    ("A1_TITLE", "0", None, "block: title"), ("BORDER", "0", None, "block: border"), ("X", "도곽", None, "layer: 도곽"), ("*U1", "TITLEBLOCK", None, "layer: title"), ("DOOR", "A-DOOR", None, None),
    ("SUBTITLE", "0", None, None), ("DOOR", "0", "drawingNumber,drawingTitle", "attributes: drawingNumber, drawingTitle"), ("타이틀", "0", None, "block: 타이틀"), ("표제란1", "0", None, "block: 표제란"), ("X", "BORDER-LINE", None, "layer: border"),
]


@query("S-01 S-02 S-03 P-11", f"SELECT p_partkey, label, confidence, method FROM part JOIN {values(RULE_CASES, 'e, l, b, a, label, confidence, method')} ON p_partkey % {len(RULE_CASES)} = k")
def rule_cases(t, spark):
    own = cases(t, spark, RULE_CASES, "entity_type string, layer string, block string, attributes string", 4)
    return rules.classified(own.select("p_partkey", "entity_type", "layer", "block", "attributes")).select("p_partkey", "label", "confidence", "method")


@query("S-04", f"SELECT p_partkey, why FROM part JOIN {values(TITLE_CASES, 'b, l, f, why')} ON p_partkey % {len(TITLE_CASES)} = k")
def title_blocks(t, spark):
    own = cases(t, spark, TITLE_CASES, "block string, layer string, fields string", 3)
    fields = F.map_from_arrays(F.split("fields", ","), F.split("fields", ","))
    return own.select("p_partkey", rules.title_block(F.col("block"), fields, F.col("layer")).alias("why"))


def of_texts(own: DataFrame, texts: list[str], **made: Column) -> DataFrame:
    """own with columns that its texts alone decide: equal texts are read once, however many rows have them."""
    each = own.select(*texts).distinct()
    for name, value in made.items():
        each = each.select("*", F.explode(F.array(value)).alias(name))  # fixed: several readers would compute it again
    same = reduce(lambda a, b: a & b, (own[c].eqNullSafe(each[c]) for c in texts))
    return own.join(each, same, "left").select(own["*"], *made)


def asked(t, spark, **made: Column) -> DataFrame:
    return of_texts(cases(t, spark, QUESTIONS, "q string", 1), ["q"], **made)


NAMES = "q, route, intents, storeys, kinds, sections, sheets, rooms, refusal, attribute, memory"


@query("G-18", f"SELECT p_partkey, route FROM part JOIN {values(QUESTIONS, NAMES)} ON p_partkey % {len(QUESTIONS)} = k")
def ask_route(t, spark):
    return asked(t, spark, link=routing.linked(F.col("q")), route=routing.route(F.col("link"))).select("p_partkey", "route")


@query("S-36", f"SELECT p_partkey, intents FROM part JOIN {values(QUESTIONS, NAMES)} ON p_partkey % {len(QUESTIONS)} = k")
def ask_intents(t, spark):
    return asked(t, spark, link=routing.linked(F.col("q"))).select("p_partkey", F.array_join("link.intents", ",").alias("intents"))


@query("S-37 S-35 G-17", f"SELECT p_partkey, storeys, kinds, sections, sheets, rooms FROM part JOIN {values(QUESTIONS, NAMES)} ON p_partkey % {len(QUESTIONS)} = k")
def ask_links(t, spark):
    return asked(t, spark, link=routing.linked(F.col("q"))).select("p_partkey", *[F.array_join(f"link.{c}", ",").alias(c) for c in ("storeys", "kinds", "sections", "sheets", "rooms")])


@query("F-27", f"SELECT p_partkey, refusal, attribute FROM part JOIN {values(QUESTIONS, NAMES)} ON p_partkey % {len(QUESTIONS)} = k")
def ask_gate(t, spark):
    refusal = F.coalesce(routing.refusal(F.col("q"), F.col("link")), F.lit(""))
    return asked(t, spark, link=routing.linked(F.col("q")), refusal=refusal, attribute=F.coalesce(routing.attribute(F.col("q")), F.lit(""))).select("p_partkey", "refusal", "attribute")


@query("F-27", f"SELECT p_partkey, missing FROM part JOIN {values(GATED, 'q, c, missing')} ON p_partkey % {len(GATED)} = k")
def ask_evidence(t, spark):
    own = cases(t, spark, GATED, "q string, c string", 2)
    return of_texts(own, ["q", "c"], missing=routing.missing(F.col("q"), F.array("c"))).select("p_partkey", "missing")


@query("G-19", f"SELECT p_partkey, memory AS route FROM part JOIN {values(QUESTIONS, NAMES)} ON p_partkey % {len(QUESTIONS)} = k")
def memory_route(t, spark):
    return asked(t, spark, route=routing.memory_route(F.col("q"))).select("p_partkey", "route")


@query("S-59", f"SELECT p_partkey, shown FROM part JOIN {values(TOPICS, 'w, shown')} ON p_partkey % {len(TOPICS)} = k")
def topic_particles(t, spark):
    return cases(t, spark, TOPICS, "w string", 1).select("p_partkey", routing.topic(F.col("w")).alias("shown"))


@query("S-34", f"SELECT p_partkey, shown FROM part JOIN {values(TRANSLATED, 'q, shown')} ON p_partkey % {len(TRANSLATED)} = k")
def glossary_translation(t, spark):
    """Questions are few: each is translated on the driver, then joined."""
    known = spark.createDataFrame([(q, ask.translate(q, GLOSSARY)) for q, _ in TRANSLATED], "q string, shown string")
    return cases(t, spark, TRANSLATED, "q string", 1).join(F.broadcast(known), "q").select("p_partkey", "shown")


@query("P-02", "SELECT src AS subject, predicate, dst AS object, CASE WHEN dst LIKE '%7' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, '{{\"layer\":\"' || predicate || '\",\"source\":\"' || src || '\"}}' AS provenance_json FROM {edges}")
def relations_rows(t, spark):
    own = t("edges").select(F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"), F.when(F.endswith("dst", F.lit("7")), 0.5).alias("confidence"), F.struct(F.col("predicate").alias("layer"), F.col("src").alias("source")).alias("provenance"))
    return relations_table(own)


@query("A-28", """WITH h AS (SELECT l_orderkey AS case_id, l_linenumber AS rank, l_partkey % 50 AS canonical, l_suppkey % 7 AS source, l_linestatus AS revision, l_partkey AS external, l_returnflag <> 'A' AS known FROM lineitem WHERE l_linenumber <= 5),
 d AS (SELECT *, row_number() OVER (PARTITION BY case_id, external ORDER BY rank) > 1 AS again FROM h),
 c AS (SELECT case_id, count(*) AS hits, count(DISTINCT CASE WHEN canonical < 10 THEN canonical END) AS found, min(CASE WHEN canonical < 10 THEN rank END) AS first, count(*) FILTER (WHERE source >= 5) AS leaked, count(*) FILTER (WHERE revision <> 'O') AS stale, count(*) FILTER (WHERE again) AS twice, count(*) FILTER (WHERE known) AS covered FROM d GROUP BY 1)
SELECT case_id, hits, round(found / 10.0::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, leaked AS unauthorized, stale, twice AS duplicates, round(covered::DOUBLE / hits, 6) AS coverage FROM c""")
def benchmark_metrics(t, spark):
    hits = t("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 50).alias("canonical_id"), (F.col("l_suppkey") % 7).alias("source_id"), F.col("l_linestatus").alias("revision_id"), F.col("l_partkey").alias("external_id"), (F.col("l_returnflag") != "A").alias("provenance"))
    expected = spark.range(10).select(F.col("id").alias("canonical_id"))
    allowed, current = spark.range(5).select(F.col("id").alias("source_id")), spark.range(7).select(F.col("id").alias("source_id"), F.lit("O").alias("revision_id"))
    out = evaluation.retrieval_metrics(hits, expected, allowed, current, 5)
    return out.select("case_id", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank")], "unauthorized", "stale", "duplicates", F.round("coverage", 6).alias("coverage"))


@query("A-29 A-31", """WITH r AS (SELECT o_orderpriority AS kind, o_orderstatus <> 'P' AS answerable, o_orderkey % 3 > 0 AS hit, o_orderkey % 5 AS route, o_custkey % 5 AS wanted, o_orderkey % 4 = 0 AS refused, o_orderkey % 6 AS citations, least(o_orderkey % 6, o_custkey % 6) AS valid FROM orders)
SELECT kind, count(*) AS questions, count(*) FILTER (WHERE answerable) AS answerable, round((count(*) FILTER (WHERE answerable AND hit))::DOUBLE / greatest(1, count(*) FILTER (WHERE answerable)), 3) AS recall, round((count(*) FILTER (WHERE answerable AND route = wanted))::DOUBLE / greatest(1, count(*) FILTER (WHERE answerable)), 3) AS route_accuracy,
 round(sum(valid)::DOUBLE / greatest(1, sum(citations)), 3) AS citation_validity, round((count(*) FILTER (WHERE NOT answerable AND refused))::DOUBLE / greatest(1, count(*) FILTER (WHERE NOT answerable)), 3) AS refusal_accuracy, count(*) FILTER (WHERE answerable AND refused) AS false_refusals,
 round((count(*) FILTER (WHERE answerable AND citations > 0 AND NOT refused))::DOUBLE / greatest(1, count(*) FILTER (WHERE answerable)), 3) AS answered_with_citation FROM r GROUP BY 1""")
def rag_summary(t, spark):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    own = t("orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") != "P").alias("answerable"), (n % 3 > 0).alias("hit"), (n % 5).alias("route"), (c % 5).alias("route_expected"), (n % 4 == 0).alias("refused"), (n % 6).alias("citations"), F.least(n % 6, c % 6).alias("citations_valid"))
    return evaluation.rag_summary(own, "kind")


@query("S-43 G-25", f"""WITH d AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part), w AS (SELECT r_regionkey AS question_id, unnest(CASE r_regionkey % 3 WHEN 0 THEN [['red', 'widget'], ['red widget', 'redwidget']] WHEN 1 THEN [['brand', 'bolt'], ['brand bolt', 'brandbolt']] ELSE [['brand', 'small'], ['brand small', 'brandsmall']] END) AS terms FROM region),
 a AS (SELECT question_id, unnest(terms) AS term FROM w), p AS (SELECT a.*, (term LIKE '% %') AS apart, term IN ('redwidget', 'brandbolt', 'brandsmall') AS together FROM a), k AS (SELECT name, {SEQUENCE.format('name')} AS s FROM d), g AS (SELECT *, {GRAMS.format('term')} AS t FROM p),
 v AS (SELECT question_id, term, apart, together, name, {EXTENT} AS v FROM g, k), f AS (SELECT question_id, term FROM v WHERE NOT apart AND NOT together AND v >= 0.6::DOUBLE GROUP BY 1, 2 HAVING count(*) <= 600),
 c AS (SELECT DISTINCT question_id, name FROM v WHERE v >= 0.6::DOUBLE AND ((question_id, term) IN (SELECT question_id, term FROM f) OR (apart AND question_id NOT IN (SELECT question_id FROM f))))
SELECT question_id, name, round(0.5::DOUBLE * avg(v) FILTER (WHERE NOT apart AND NOT together) + 0.5::DOUBLE * max(v) FILTER (WHERE apart OR together), 6) AS score FROM v JOIN c USING (question_id, name) GROUP BY 1, 2""")
def pack_drawing_candidates(t, spark):
    """A question for each region, all in one plan; terms that more than 600 drawings resemble do not choose candidates."""
    own = t("part").select(F.concat_ws(" ", "p_brand", "p_name").alias("name")).distinct().withColumn("body", F.col("name"))
    asked = F.when(F.col("r_regionkey") % 3 == 0, "red widget?").when(F.col("r_regionkey") % 3 == 1, "brand, bolt").otherwise("brand small!")
    questions = t("region").select(F.col("r_regionkey").alias("question_id"), asked.alias("question"))
    return search.pack_drawings(own, "name", "body", questions).withColumn("score", F.round("score", 6))


@query("T-12", """WITH b AS (SELECT id, src, dst, predicate FROM (SELECT src || '>' || predicate || '>' || dst AS id, src, dst, predicate FROM {edges})), h1 AS (SELECT id, 1 AS hop, predicate FROM b WHERE src = 'r1' OR dst = 'r1' QUALIFY row_number() OVER (ORDER BY predicate = 'contains', predicate, id) <= 12),
 f AS (SELECT DISTINCT n FROM (SELECT unnest([src, dst]) AS n FROM b WHERE id IN (SELECT id FROM h1)) WHERE n <> 'r1'), h2 AS (SELECT id, 2 AS hop, predicate FROM b WHERE (src IN (SELECT n FROM f) OR dst IN (SELECT n FROM f)) AND id NOT IN (SELECT id FROM h1) AND NOT (predicate = 'contains' AND src IN (SELECT n FROM f)) QUALIFY row_number() OVER (ORDER BY predicate = 'contains', predicate, id) <= 12 - (SELECT count(*) FROM h1))
SELECT id, CAST(hop AS INTEGER) AS hop FROM h1 UNION ALL SELECT id, CAST(hop AS INTEGER) FROM h2""")
def limited_neighbourhood(t, spark):
    own = t("edges").withColumn("id", F.concat_ws(">", "src", "predicate", "dst"))
    return graph.neighbourhood(own, "r1", 2, 12).select("id", "hop")
