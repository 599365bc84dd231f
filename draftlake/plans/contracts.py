"""Queries on contracts, portable tables, questions and further text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftlake.functions import text
from draftlake.operators import ask, contracts, joins, portable, ranking, relations, rules
from draftlake.plans.adapters import query


@query("P-03", "SELECT id AS object_id, kind AS label, confidence FROM {objects} WHERE state = 'AI_INFERRED'")
def classifications_table(t, spark):
    made = F.when(F.col("state") == "AI_INFERRED", F.struct(F.col("kind").alias("label"), "confidence"))
    return portable.classifications(t("objects").select("id", made.alias("classification")))


@query("P-04", "SELECT id AS object_id, layer AS source_object, 'DXF' AS source_format FROM {objects} WHERE block IS NOT NULL")
def provenance_table(t, spark):
    made = F.when(F.col("block").isNotNull(), F.struct(F.col("layer").alias("source_object"), F.lit("DXF").alias("source_format")))
    return portable.provenance(t("objects").select("id", made.alias("provenance")))


@query("P-06 P-29", "SELECT id AS global_object_id, project_id, layer AS source_file, block AS source_entity_id FROM {objects}")
def source_mapping_table(t, spark):
    return portable.source_mappings(t("objects").select("id", "project_id", F.struct(F.col("layer").alias("file"), F.col("block").alias("entity_id")).alias("source")))


@query("P-08", "SELECT 'geom:' || coalesce(block, layer) AS geometry_ref, coalesce(block, layer) AS source_entity_id, kind AS geometry_type, 'local' AS crs FROM {objects}")
def geometry_index_table(t, spark):
    none = F.lit(None).cast("string")
    own = t("objects").select(none.alias("handle"), F.col("block").alias("source_entity_id"), F.col("layer").alias("source_id"), none.alias("feature_id"), "kind", none.alias("crs"))
    return portable.geometry_index(own)


@query("P-09 SK-30", "WITH n AS (SELECT source AS project_id, lang AS artifact_type, sha256(text) AS sha256 FROM documents GROUP BY ALL) SELECT project_id, artifact_type, sha256 FROM n WHERE (project_id, artifact_type, sha256) NOT IN (SELECT (source, lang, sha256(text)) FROM documents WHERE doc_id % 3 = 0)")
def artifact_put(t, spark):
    rows = t("documents").select(F.col("source").alias("project_id"), F.col("lang").alias("artifact_type"), F.sha2("text", 256).alias("sha256"), "doc_id")
    return portable.put_artifacts(rows.where("doc_id % 3 = 0"), rows).select("project_id", "artifact_type", "sha256")


@query("P-21 P-20", "SELECT id, substr(trim(type || ' ' || name || ' p ' || id), 1, 2000) AS search_text FROM {nodes}")
def node_search_text(t, spark):
    from draftlake.operators.knowledge import search_text

    return t("nodes").select("id", search_text(F.col("type"), F.col("name"), F.lit("p"), F.col("id")).alias("search_text"))


@query("P-24", "SELECT 'ctx_' || substr(sha256('r1' || chr(31) || item_id), 1, 24) AS id, CAST(item_id AS VARCHAR) AS external_id, trim(text) AS text FROM benchmark")
def context_records(t, spark):
    return portable.context_records(t("benchmark"), F.lit("r1"), F.col("item_id").cast("string"), F.col("text"))


@query("P-28", "SELECT document_id, number || ' ' || name || ' [' || category || ']' AS line FROM {drawings}")
def drawing_lines(t, spark):
    return t("drawings").select("document_id", portable.drawing_line(F.col("number"), F.col("name"), F.col("category"), F.lit(None).cast("string")).alias("line"))


@query("F-01 F-15", "SELECT id FROM {objects} WHERE project_id = 'P1' AND kind = 'Wall' AND storey = '2F' AND category = 'detail'")
def search_base_filter(t, spark):
    return t("objects").where("project_id = 'P1' and kind = 'Wall' and storey = '2F' and category = 'detail'").select("id")


@query("F-02 S-15", "SELECT id FROM {objects} WHERE storey = '3F' OR (storey = '' AND regexp_matches(layer || ' ' || label || ' 3f', '(^|[^0-9a-z])0*3 ?f') AND n = 5)")
def storey_predicate(t, spark):
    own = t("objects").select("id", "n", "storey", F.col("layer").alias("name"), F.when(F.col("n") == 5, F.concat("label", F.lit(" 3f"))).otherwise(F.lit("")).alias("search_text"))
    return own.where(ask.storey_filter("3F")).select("id")


@query("F-08", "SELECT user_id FROM (SELECT user_id, list(DISTINCT event_type) AS names FROM events GROUP BY 1) WHERE len(list_filter(names, lambda x: x ILIKE '%ur%')) > 0")
def array_any_match(t, spark):
    own = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    return own.where(F.exists("names", lambda x: x.ilike("%ur%"))).select("user_id")


@query("F-16", "SELECT 'draft://project/' || project_id || '/' || id AS subject FROM {objects} WHERE project_id IN ('P1', 'P3')")
def local_relation_filter(t, spark):
    uri = F.concat(F.lit("draft://project/"), F.col("project_id"), F.lit("/"), F.col("id").cast("string"))
    rel = t("objects").select(uri.alias("subject"), F.concat(F.lit("draft://project/"), "project_id").alias("object"))
    return contracts.local_relations(rel, t("objects").where("project_id in ('P1', 'P3')").select("project_id").distinct()).select("subject")


@query("F-18", "SELECT page_id FROM pages WHERE starts_with(regexp_replace(url, '^https?://[^/]+', ''), '/en/')")
def root_containment(t, spark):
    return t("pages").where(F.startswith(F.regexp_replace("url", "^https?://[^/]+", ""), F.lit("/en/"))).select("page_id")


@query("F-20", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src5') AND lang = 'en'")
def acl_current_revision(t, spark):
    sources = t("documents").select("source").distinct().select("source", F.lit("en").alias("current"), F.lit(True).alias("active"), F.when(F.col("source").isin("src1", "src2", "src5"), "public").otherwise("closed").alias("acl"))
    return contracts.visible(t("documents").select("doc_id", "source", F.col("lang").alias("revision")), sources, ["public"]).select("doc_id")


@query("F-28", "SELECT count(*) > 0 AS found FROM {nodes} WHERE regexp_matches(name, '(?i)customer#0+7$')")
def evidence_probe(t, spark):
    return t("nodes").where(F.col("name").rlike("(?i)customer#0+7$")).limit(1).agg((F.count("*") > 0).alias("found"))


@query("J-11", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def name_resolution(t, spark):
    own = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


AREA_LABELS = """WITH RECURSIVE r AS (SELECT {sheet4} AS sheet, id, min_x AS x, min_y AS y, row_number() OVER (PARTITION BY {sheet4} ORDER BY id) AS k FROM {marks}), l AS (SELECT {sheet80} AS sheet, id AS label, {value} AS value, min_x AS lx, min_y AS ly FROM {frames}),
p AS (SELECT sheet, k, id, label, value, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS d FROM r JOIN l USING (sheet) WHERE y - ly > 0 AND y - ly <= {reach} AND abs(x - lx) <= {reach}),
c AS (SELECT r.sheet, r.k, r.id, coalesce(list({{'label': label, 'value': value}} ORDER BY d, label) FILTER (WHERE label IS NOT NULL), []) AS cands FROM r LEFT JOIN p USING (sheet, k) GROUP BY r.sheet, r.k, r.id),
g AS (SELECT DISTINCT sheet, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS label, CAST(NULL AS DOUBLE) AS value, CAST([] AS BIGINT[]) AS used FROM r
 UNION ALL SELECT c.sheet, c.k, c.id, f.label, f.value, CASE WHEN f.label IS NULL THEN g.used ELSE list_append(g.used, f.label) END FROM g JOIN c ON c.sheet = g.sheet AND c.k = g.k + 1, LATERAL (SELECT list_filter(c.cands, lambda x: NOT list_contains(g.used, x.label))[1] AS f) t(f))
SELECT label, id AS space, value AS area FROM g WHERE value > 0"""


def area_labels_sql(room_sheet: str, label_sheet: str, value: str, reach: int) -> str:
    """The greedy match in the order of rooms, by recursion over each sheet's rooms."""
    return AREA_LABELS.replace("{sheet4}", room_sheet).replace("{sheet80}", label_sheet).replace("{value}", value).replace("{reach}", str(reach))


@query("J-18 J-30", area_labels_sql("0", "0", "max_x", 60))
def greedy_area_labels(t, spark):
    """Area labels of one sheet, used once each, rooms in their order."""
    spaces = t("marks").select(F.lit("S").alias("sheet"), "id", F.col("id").alias("idx"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    labels = t("frames").select(F.lit("S").alias("sheet"), "id", F.col("max_x").alias("value"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    return relations.area_labels(spaces, labels, 60.0)


@query("J-18 J-30", area_labels_sql("id // 4", "id // 80", "max_x - 300", 300))
def sheet_area_labels(t, spark):
    """Area labels of every sheet; those without a positive area use up their place."""
    spaces = t("marks").select(F.floor(F.col("id") / 4).alias("sheet"), "id", F.col("id").alias("idx"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    labels = t("frames").select(F.floor(F.col("id") / 80).alias("sheet"), "id", (F.col("max_x") - 300).alias("value"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    return relations.area_labels(spaces, labels, 300.0)


#: Sheets of frames: each frame gives two walls, of which the second stands aslant.
SHEETED = """w AS (SELECT id // 80 AS sheet, CAST(id * 2 AS BIGINT) AS wall, min_x AS x1, min_y AS y1, max_x AS x2, min_y AS y2 FROM {frames} UNION ALL SELECT id // 80, id * 2 + 1, min_x, max_y, min_x + 3 * (max_y - min_y), min_y FROM {frames}),
 e AS (SELECT id // 4 AS sheet, id, min_x + 0.25 AS x, min_y + 0.125 AS y FROM {marks}), s AS (SELECT id // 80 AS sheet, id AS space, min_x + 1.5 AS lx, min_y + 1.375 AS ly FROM {frames} WHERE id % 10 = 0)"""


def sheeted(t):
    """Walls (sheet, id, idx, x1, y1, x2, y2), elements (sheet, id, x, y) and rooms (sheet, id, x, y): see SHEETED."""
    c, sheet = F.col, F.floor(F.col("id") / 80).alias("sheet")
    one = t("frames").select(sheet, (c("id") * 2).alias("id"), c("min_x").alias("x1"), c("min_y").alias("y1"), c("max_x").alias("x2"), c("min_y").alias("y2"))
    two = t("frames").select(sheet, (c("id") * 2 + 1).alias("id"), c("min_x").alias("x1"), c("max_y").alias("y1"), (c("min_x") + 3 * (c("max_y") - c("min_y"))).alias("x2"), c("min_y").alias("y2"))
    elements = t("marks").select(F.floor(c("id") / 4).alias("sheet"), "id", (c("min_x") + 0.25).alias("x"), (c("min_y") + 0.125).alias("y"))
    rooms = t("frames").where("id % 10 = 0").select(sheet, "id", (c("min_x") + 1.5).alias("x"), (c("min_y") + 1.375).alias("y"))
    return one.unionByName(two).withColumn("idx", c("id")), elements, rooms


def sql_turn(*p: str) -> str:
    """(b - a) x (c - a) of three points."""
    ax, ay, bx, by, cx, cy = p
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


CROSSES = f"({sql_turn('x', 'y', 'lx', 'ly', 'x1', 'y1')} * {sql_turn('x', 'y', 'lx', 'ly', 'x2', 'y2')} < 0 AND {sql_turn('x1', 'y1', 'x2', 'y2', 'x', 'y')} * {sql_turn('x1', 'y1', 'x2', 'y2', 'lx', 'ly')} < 0)"


@query("J-20 G-36", f"""WITH {SHEETED}, v AS (SELECT e.id, space, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS d FROM e JOIN s USING (sheet) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sheet = e.sheet AND {CROSSES}))
SELECT id, arg_min(space, (d, space)) AS space, round(min(d), 6) AS distance FROM v GROUP BY 1""")
def line_of_sight_rooms(t, spark):
    """Elements and the nearest rooms of their sheets that no wall parts from them."""
    walls, elements, rooms = sheeted(t)
    return relations.nearest_in_sight(elements, rooms, walls).select("id", "space", F.round("distance", 6).alias("distance"))


@query("G-36 J-17 J-20 J-21 J-22 J-24", f"""WITH {SHEETED}, t AS (SELECT DISTINCT sheet, 'P' || sheet % 3 AS project, CASE WHEN sheet % 2 = 0 THEN 'A-' || sheet ELSE '' END AS number, CASE WHEN sheet % 3 = 0 THEN sheet % 5 + 1 || '층 평면도' ELSE '상세' END AS title FROM w),
 sh AS (SELECT *, 'sheet:' || coalesce(nullif(number, ''), CAST(sheet AS VARCHAR)) AS subject, CASE WHEN sheet % 3 = 0 THEN 'storey:' || sheet % 5 + 1 || 'F' END AS level FROM t),
 q AS (SELECT e.id, wall, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS n, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM e JOIN w USING (sheet)), p AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x1) * dx + (y - y1) * dy) / n)) END AS t FROM q), d AS (SELECT id, wall, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS d FROM p),
 b AS (SELECT id // 80 AS sheet, min_x, min_y, max_x, max_y, (max_x - min_x) * (max_y - min_y) AS area, id AS boundary FROM {{frames}} WHERE id % 5 = 0), rg AS (SELECT s.sheet, space, arg_min(b, (area, boundary)) AS b FROM s JOIN b ON b.sheet = s.sheet AND lx > min_x AND lx < max_x AND ly > min_y AND ly < max_y GROUP BY 1, 2),
 i AS (SELECT e.id, min(space) AS space FROM e JOIN rg ON rg.sheet = e.sheet AND x > b.min_x AND x < b.max_x AND y > b.min_y AND y < b.max_y GROUP BY 1), v AS (SELECT e.id, space, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS d FROM e JOIN s USING (sheet) WHERE e.id NOT IN (SELECT id FROM i) AND NOT EXISTS (SELECT 1 FROM w WHERE w.sheet = e.sheet AND {CROSSES})),
 pr AS (SELECT id // 80 AS sheet, id, min_x, min_y, max_x, max_y, greatest(15.0, max_x - min_x, max_y - min_y) AS reach FROM {{frames}} WHERE id % 7 = 0), ld AS (SELECT pr.id, e.id AS label, sqrt(greatest(pr.min_x - x, x - pr.max_x, 0) ** 2 + greatest(pr.min_y - y, y - pr.max_y, 0) ** 2) AS d, reach FROM pr JOIN e USING (sheet)),
 u AS (SELECT CAST(id AS VARCHAR) AS subject, 'hostedBy' AS predicate, CAST(arg_min(wall, (d, wall)) AS VARCHAR) AS object, round(min(d), 6) AS distance FROM d WHERE d <= 40 GROUP BY id UNION ALL SELECT CAST(space AS VARCHAR), 'containsElement', CAST(id AS VARCHAR), NULL FROM i UNION ALL SELECT CAST(arg_min(space, (d, space)) AS VARCHAR), 'containsElement', CAST(id AS VARCHAR), round(min(d), 6) FROM v GROUP BY id
  UNION ALL SELECT CAST(id AS VARCHAR), 'relatedTo', CAST(arg_min(label, (d, label)) AS VARCHAR), round(min(d), 6) FROM ld WHERE d <= reach GROUP BY id UNION ALL SELECT 'aec://project/' || project, 'containsElement', subject, NULL FROM sh UNION ALL SELECT subject, 'depicts', CAST(space AS VARCHAR), NULL FROM sh JOIN s USING (sheet)
  UNION ALL SELECT DISTINCT 'aec://project/' || project, 'containsElement', level, CAST(NULL AS DOUBLE) FROM sh WHERE level IS NOT NULL UNION ALL SELECT subject, 'depicts', level, NULL FROM sh WHERE level IS NOT NULL UNION ALL SELECT level, 'hasSpace', CAST(space AS VARCHAR), NULL FROM sh JOIN s USING (sheet) WHERE level IS NOT NULL UNION ALL SELECT CAST(space AS VARCHAR), 'onStorey', level, NULL FROM sh JOIN s USING (sheet) WHERE level IS NOT NULL
  UNION ALL SELECT subject, 'hasTitleBlock', CAST(m AS VARCHAR), NULL FROM sh JOIN (SELECT sheet, min(wall) AS m FROM w WHERE wall % 3 = 0 GROUP BY 1) USING (sheet)) SELECT * FROM u""")
def spatial_relations_of_sheets(t, spark):
    """All predicates of all sheets in one plan; area labels have a query of their own."""
    c = F.col
    walls, elements, rooms = sheeted(t)
    rooms = rooms.withColumn("idx", c("id"))
    sheets = walls.select("sheet").distinct().select("sheet", F.concat(F.lit("P"), c("sheet") % 3).alias("project"), F.when(c("sheet") % 2 == 0, F.concat(F.lit("A-"), "sheet")).otherwise("").alias("number"), F.when(c("sheet") % 3 == 0, F.concat(c("sheet") % 5 + 1, F.lit("층 평면도"))).otherwise("상세").alias("title"), F.when(c("sheet") % 3 == 0, "plan").otherwise("detail").alias("category"))
    corner = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    boundaries = t("frames").where("id % 5 = 0").select(F.floor(c("id") / 80).alias("sheet"), "id", F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y")).alias("ring"))
    profiles = t("frames").where("id % 7 = 0").select(F.floor(c("id") / 80).alias("sheet"), "id", "min_x", "min_y", "max_x", "max_y")
    labels, none = elements.withColumn("designation", F.lit("H-100x50")), elements.limit(0).withColumn("value", F.lit(0.0))
    out = relations.build(sheets, elements, walls, rooms, none, boundaries, elements, profiles, labels, walls.where("id % 3 = 0"), 40.0, 30.0)
    return out.select("subject", "predicate", "object", F.round("distance", 6).alias("distance"))


@query("J-17 X-37", f"""WITH {SHEETED}, q AS (SELECT e.id, wall, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS n, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM e JOIN w USING (sheet)),
 p AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - x1) * dx + (y - y1) * dy) / n)) END AS t FROM q), d AS (SELECT id, wall, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) AS d FROM p)
SELECT id, arg_min(wall, (d, wall)) AS host, round(min(d), 6) AS distance FROM d WHERE d <= 40 GROUP BY 1""")
def opening_hosts(t, spark):
    walls, openings, _ = sheeted(t)
    return relations.hosted(openings, walls, 40.0).select(F.col("subject").alias("id"), F.col("object").alias("host"), F.round("distance", 6).alias("distance"))


@query("J-32 G-39", "SELECT a.doc_id AS document, b.page_id AS drawing FROM documents a JOIN pages b ON a.lang = 'en' AND a.doc_id = b.page_id")
def stem_links(t, spark):
    n = lambda c, p, s: F.concat(F.lit(p), F.col(c).cast("string"), F.lit(s))
    docs = t("documents").where("lang = 'en'").select(F.lit("P").alias("project"), F.col("doc_id").alias("id"), n("doc_id", "Spec_No-", ".pdf").alias("name"))
    draws = t("pages").select(F.lit("P").alias("project"), F.col("page_id").alias("id"), n("page_id", "x/SPEC NO ", ".dwg").alias("name"))
    return portable.stem_links(docs, draws)


@query("A-19", "SELECT kind, storey, max(n) AS most, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM {objects} WHERE storey <> '' GROUP BY 1, 2")
def kind_storey_gold(t, spark):
    return t("objects").where("storey != ''").groupBy("kind", "storey").agg(F.max("n").alias("most"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


@query("W-07 T-13", "SELECT n_nationkey, 'K:strategy:' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) - 1) AS ordinal FROM nation")
def ordinal_ids(t, spark):
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name", "n_nationkey")) - 1
    return t("nation").select("n_nationkey", F.concat(F.lit("K:strategy:"), n.cast("string")).alias("ordinal"))


@query("W-10 J-29", """WITH f AS (SELECT id // 80 AS sheet, id, min_x AS lo, min_x + 80 AS hi, min_y AS o FROM {frames} UNION ALL SELECT id // 80, id + 100000000, min_x, min_x + 80, min_y + 2 + id % 3 FROM {frames} UNION ALL SELECT id // 80, id + 200000000, min_x, min_x + 80, min_y + 5 + id % 7 FROM {frames} WHERE id % 4 = 0),
 p AS (SELECT a.sheet, a.id, b.id AS other, abs(a.o - b.o) AS gap FROM f a JOIN f b ON a.sheet = b.sheet AND a.id <> b.id AND least(a.hi, b.hi) > greatest(a.lo, b.lo) AND a.o <> b.o AND abs(a.o - b.o) <= 10),
 n AS (SELECT sheet, id, arg_min(other, (gap, other)) AS other, min(gap) AS gap, (list(gap ORDER BY gap))[2] AS second FROM p GROUP BY 1, 2)
SELECT a.sheet, a.id, a.other, round(a.gap, 6) AS gap FROM n a JOIN n b ON a.sheet = b.sheet AND a.other = b.id AND b.other = a.id WHERE a.id < a.other AND a.gap BETWEEN 1 AND 5 AND (a.second IS NULL OR a.second >= 2 * a.gap) AND (b.second IS NULL OR b.second >= 2 * a.gap)""")
def wall_face_pairs(t, spark):
    """Faces of every sheet that are each other's nearest parallel, and far from any third."""
    x, y, sheet = F.col("min_x"), F.col("min_y"), F.floor(F.col("id") / 80).alias("sheet")
    faces = t("frames").select(sheet, "id", x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), y.alias("y2"))
    low = y + 2 + F.col("id") % 3
    other = t("frames").select(sheet, (F.col("id") + 100_000_000).alias("id"), x.alias("x1"), low.alias("y1"), (x + 80).alias("x2"), low.alias("y2"))
    far = y + 5 + F.col("id") % 7
    third = t("frames").where("id % 4 = 0").select(sheet, (F.col("id") + 200_000_000).alias("id"), x.alias("x1"), far.alias("y1"), (x + 80).alias("x2"), far.alias("y2"))
    return relations.wall_pairs(faces.unionByName(other).unionByName(third), 1.0, 5.0).withColumn("gap", F.round("gap", 6))


@query("D-05", "SELECT 'c' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
def concatenated_snapshots(t, spark):
    return t("customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key")).unionByName(t("supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key")))


@query("S-08", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'hall' END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE END AS area FROM part")
def room_labels(t, spark):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("hall ("), n, F.lit(".5 m2)"))).when(k == 1, F.concat(F.lit("hall\n"), n, F.lit("㎡"))).otherwise(F.lit("127"))
    return t("part").select("p_partkey", text.room_label(raw).alias("r")).select("p_partkey", "r.name", "r.area")


@query("S-16", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (1 + p_size % 20) || 'F' END AS storey FROM part")
def sheet_storeys(t, spark):
    title = F.concat((1 + F.col("p_size") % 20).cast("string"), F.lit("층 평면도"))
    return t("part").select("p_partkey", text.sheet_storey(title, F.when(F.col("p_partkey") % 2 == 0, "plan").otherwise("section")).alias("storey"))


@query("S-18 S-17", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'site-' || s_suppkey WHEN 1 THEN 'mark-' || s_suppkey ELSE 'leaf-' || s_suppkey END AS key, CASE s_suppkey % 3 WHEN 0 THEN '허가' ELSE '' END AS phase FROM supplier")
def canonical_projects(t, spark):
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 3
    folder = F.when(k == 0, F.concat(F.lit("Site "), n, F.lit("/#허가"))).when(k == 1, F.concat(F.lit("##Mark "), n, F.lit("/anything"))).otherwise(F.concat(F.lit("###프로젝트/Leaf "), n))
    return t("supplier").select("s_suppkey", text.project(folder).alias("p")).select("s_suppkey", "p.key", "p.phase")


@query("S-20 P-22 SC-04", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A-' || (100 + p_size) END AS number, CASE WHEN p_partkey % 2 = 0 THEN '2층 평면' ELSE 'free text' END AS title FROM part")
def sheet_name_fields(t, spark):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("03_a-"), (100 + F.col("p_size")).cast("string"), F.lit(" - [ 2층 평면 ].dwg"))).otherwise(F.lit("free text.dwg"))
    return t("part").select("p_partkey", text.sheet_fields(name).alias("f")).select("p_partkey", "f.number", "f.title")


@query("S-35 S-37", "SELECT conv_id, turn, regexp_matches(text, '(?i)the') AS latin, false AS hangul FROM conversations")
def whole_words(t, spark):
    return t("conversations").select("conv_id", "turn", text.whole_word(F.col("text"), "the").alias("latin"), text.whole_word(F.concat(F.col("text"), F.lit(" 문서")), "문").alias("hangul"))


@query("S-54 S-55", "SELECT id, min_x / 2 * 1000 AS x FROM {frames}")
def representative_points(t, spark):
    from draftlake.functions import spatial

    none = F.lit(None).cast("double")
    return t("frames").select("id", (spatial.representative(none, none, none, F.col("min_x") / 2, F.col("max_x")) * text.unit_scale(F.lit("M"))).alias("x"))


@query("S-57", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def utc_texts(t, spark):
    return t("events").select("event_id", text.utc_text(F.col("ts")).alias("at"))


@query("S-62", "SELECT s_suppkey, 'H;1.5;m' AS terms FROM supplier")
def title_terms(t, spark):
    return t("supplier").select("s_suppkey", F.array_join(text.relevance_terms(F.lit("H, (1.5) m.")), ";").alias("terms"))


@query("S-62", "SELECT p_partkey, replace(p_name, ' ', ';') || ';' || p_size || '.5;' || p_type AS terms FROM part")
def title_term_lists(t, spark):
    """Terms of every title: punctuation goes, decimal points stay."""
    title = F.concat("p_name", F.lit(", ("), "p_size", F.lit(".5) "), "p_type", F.lit("."))
    return t("part").select("p_partkey", F.array_join(text.relevance_terms(title), ";").alias("terms"))


@query("S-31 S-24", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Wall' WHEN p_type = 'SMALL' THEN 'SteelSection' ELSE 'CADEntity' END AS label FROM part")
def layer_classifiers(t, spark):
    layer = F.when(F.col("p_type") == "ECONOMY", "A-ELEV-OTLN").when(F.col("p_type") == "SMALL", "S-STL").otherwise("X-0")
    none = F.lit(None).cast("string")
    own = t("part").select("p_partkey", F.lit("LINE").alias("entity_type"), layer.alias("layer"), none.alias("block"), none.alias("attributes"))
    return rules.classified(own, distinct=True).select("p_partkey", "label")


@query("S-32 G-27 G-29", "SELECT id, name FROM {nodes} WHERE contains(lower(name), 'nation_2') ORDER BY length(name), name, id LIMIT 10")
def summary_template(t, spark):
    own = t("nodes").select("id", "type", "name", F.col("name").alias("search_text"), F.lit("p").alias("project_key"))
    return ask.candidates(own, "nation_2 list", 10).select("id", "name")


@query("G-30 S-34", "SELECT id FROM {nodes} WHERE contains(lower(name), 'supplier#00000001') ORDER BY length(name), name, id LIMIT 10")
def retrieve_with_fallback(t, spark):
    own = t("nodes").select("id", "type", "name", F.col("name").alias("search_text"), F.lit("p").alias("project_key"))
    return ask.retrieve(own, "supplier#00000001", "graph:drawings", 10).select("id")


@query("G-46 X-12 X-13", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'state_mismatch' END, CASE WHEN o_totalprice > 400000 THEN 'large' END) AS reasons FROM orders")
def binding_reasons(t, spark):
    found = contracts.binding_reasons({"state": F.col("o_orderstatus")}, {"state": F.lit("F")}, {"large": F.col("o_totalprice") > 400000})
    return t("orders").select("o_orderkey", F.array_join(found, ",").alias("reasons"))


@query("G-49", """WITH c AS (SELECT o_custkey AS source, o_orderkey AS revision, o_orderpriority AS digest, o_orderstatus = 'P' AS gone FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT o_custkey AS source, o_orderkey AS revision, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS digest, o_orderkey - 1 AS expected FROM orders),
h AS (SELECT source, max(revision) AS head FROM c GROUP BY 1) SELECT i.source, i.revision, CASE WHEN coalesce(gone, false) THEN 'revoked' WHEN c.digest <> i.digest THEN 'conflict' WHEN c.digest IS NOT NULL THEN 'same' WHEN expected IS DISTINCT FROM head THEN 'stale' ELSE 'accepted' END AS state FROM i LEFT JOIN c USING (source, revision) LEFT JOIN h USING (source)""")
def revision_ingest(t, spark):
    own = t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("revision"), F.col("o_orderpriority").alias("digest"), (F.col("o_orderstatus") == "P").alias("revoked"))
    incoming = own.select("source", "revision", F.when(F.col("revision") % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"), (F.col("revision") - 1).alias("expected"))
    return contracts.ingest(own.where("revision % 2 = 0"), incoming)


@query("ST-07 ST-08 X-26", "SELECT doc_id FROM documents WHERE (doc_id, n_chars) NOT IN (SELECT (doc_id, n_chars + doc_id % 2) FROM documents)")
def resumable_census(t, spark):
    known = t("documents").select("doc_id", (F.col("n_chars") + F.col("doc_id") % 2).alias("n_chars"))
    return t("documents").select("doc_id", "n_chars").join(known, ["doc_id", "n_chars"], "left_anti").select("doc_id")


@query("SK-17 SK-18", "SELECT subject, object FROM (SELECT src AS subject, dst AS object, CASE WHEN dst LIKE '%7' THEN 'AI_INFERRED' ELSE 'OBSERVED' END AS state FROM {edges}) WHERE state = 'OBSERVED' AND subject IN (SELECT id FROM {nodes}) AND object IN (SELECT id FROM {nodes})")
def graph_projection(t, spark):
    rel = t("edges").select(F.col("src").alias("subject"), F.col("dst").alias("object"), F.when(F.endswith("dst", F.lit("7")), "AI_INFERRED").otherwise("OBSERVED").alias("state"))
    return portable.graph_edges(rel, t("nodes")).select("subject", "object")


@query("SK-19 SK-20 X-30 X-34", "SELECT 'kc:' || id AS id, 'kb:p' AS project_key, name AS title FROM {nodes} WHERE type = 'Nation'")
def knowledge_pack_rows(t, spark):
    own = t("nodes").select("id", "type", "name", F.when(F.col("type") == "Nation", F.col("name")).otherwise("").alias("text"))
    names = own.select(F.lit("name").alias("alias_type"), F.col("name").alias("alias"), F.col("id").alias("node_id"))
    return portable.pack_tables(own, t("edges"), names, "p")[3].select("id", "project_key", "title")


@query("SK-06 SK-08", "SELECT 'dl:' || r_name || ' a owl:Class ; rdfs:subClassOf dl:Place .' AS line FROM region UNION ALL SELECT 'dl:' || n_name || ' a owl:ObjectProperty ; rdfs:domain dl:' || r_name || ' .' FROM nation JOIN region ON n_regionkey = r_regionkey")
def ontology_lines(t, spark):
    classes = t("region").select(F.col("r_name").alias("name"), F.lit("Place").alias("parent"))
    props = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("ObjectProperty").alias("kind"), F.col("r_name").alias("domain"))
    return portable.ontology(classes, props)


@query("SK-27", "SELECT project_id AS project, count(*) AS objects, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds FROM {objects} GROUP BY 1")
def memory_packages(t, spark):
    return portable.memory_package(t("objects"), "project_id").select("project", "objects", "kinds")


@query("SK-22 X-11", "SELECT DISTINCT label, sha256('{{\"dimension\":64,\"model\":\"m' || label || '\",\"normalised\":true}}') AS space FROM embeddings")
def embedding_spaces(t, spark):
    space = contracts.embedding_space(F.concat(F.lit("m"), F.col("label").cast("string")), F.lit(64), F.lit(True))
    return t("embeddings").select("label", space.alias("space")).distinct()


@query("X-01", """SELECT event_id AS id, 'a' AS provider, 'x,y' AS capabilities FROM events WHERE event_type = 'view'""")
def capability_candidates(t, spark):
    body = F.when(F.col("event_type") == "view", '{"providers":[{"id":"a","name":"A","score":9,"capabilities":["y","x"]}]}').otherwise("broken {")
    return contracts.candidates(t("events").select(F.col("event_id").alias("id"), body.alias("body"))).select("id", "provider", "capabilities")


@query("X-04", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = count(*) AND min(l_quantity) > 3")
def section_catalog_ingest(t, spark):
    rows = t("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("sha256"), F.array_repeat(F.lit(1.0), 6).alias("dims"), (F.col("l_quantity") - 3).alias("weight"))
    files = rows.select("path").distinct().select("path", F.encode(F.col("path").cast("string"), "UTF-8").alias("content"))
    own = rows.withColumn("sha256", F.sha2(F.encode(F.col("path").cast("string"), "UTF-8"), 256))
    return contracts.accepted(contracts.catalog_rows(own, files), "path").select(F.col("path").alias("l_orderkey"))


@query("X-05", "SELECT event_id, CASE event_type WHEN 'error' THEN 'NOT_RUN' WHEN 'click' THEN 'CAPABILITY_MISMATCH' WHEN 'view' THEN 'SCHEMA_MISMATCH' ELSE 'OBSERVED' END AS state FROM events")
def probe_states(t, spark):
    kind = F.col("event_type")
    state = contracts.probe_state(F.array(F.lit("b"), F.lit("a")), F.when(kind == "click", F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))), F.when(kind == "error", "down"), F.when(kind == "view", "v0").otherwise("v1"), "v1")
    return t("events").select("event_id", state.alias("state"))


@query("X-07 X-08", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'trio' ELSE 'live_keys' END AS problems FROM orders")
def legal_subjects(t, spark):
    kind = F.col("o_orderstatus")
    found = contracts.subject(F.when(kind == "F", F.repeat(F.lit("a"), 64)), F.when(kind != "P", F.lit(1)), F.when(kind == "F", "p"), F.when(kind == "P", F.array(F.lit("url"))).otherwise(F.array(F.lit("id"))), ["url", "token"])
    return t("orders").select("o_orderkey", F.array_join(found, ",").alias("problems"))


@query("X-09", "SELECT p_type AS manifest, p_partkey AS id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY p_type, p_brand) > 1 THEN 'path' END, CASE WHEN p_size > 40 THEN 'view' END) AS problems FROM part")
def artifact_manifest(t, spark):
    rows = t("part").select(F.col("p_type").alias("manifest"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.when(F.col("p_size") > 40, "odd").otherwise("plan").alias("view"), F.lit("svg").alias("format"))
    return contracts.manifest(rows, ["plan"], ["svg"]).withColumn("problems", F.array_join("problems", ","))


@query("X-10 X-36", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'digest' WHEN doc_id % 4 = 1 THEN 'size' ELSE '' END AS problems FROM documents")
def captured_sources(t, spark):
    k, body = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    found = contracts.handoff(body, F.when(k == 0, F.repeat(F.lit("0"), 64)).otherwise(F.sha2(body, 256)), F.length(body) + F.when(k == 1, 1).otherwise(0))
    return t("documents").select("doc_id", F.array_join(found, ",").alias("problems"))


@query("X-15", "SELECT event_id, CASE WHEN value / 100 > 1 OR value < 0 THEN 'recall' ELSE '' END AS bad FROM events")
def metric_validation(t, spark):
    found = contracts.metric_problems(F.create_map(F.lit("mrr"), F.lit(0.5), F.lit("recall"), F.col("value") / 100))
    return t("events").select("event_id", F.array_join(found, ",").alias("bad"))


@query("X-16", "SELECT user_id AS chunk, min(event_type) AS binding, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY 1")
def binding_registry(t, spark):
    return contracts.bindings(t("events").select(F.col("user_id").alias("chunk"), F.col("event_type").alias("source")))


@query("X-19", "SELECT 'MERGE (n:' || type || ' {{id: \"' || id || '\"}}) SET n.name = \"' || name || '\";' AS line FROM {nodes} ORDER BY line LIMIT 12")
def projection_preview(t, spark):
    from draftlake.sinks.text import cypher_nodes

    return ranking.top_k(cypher_nodes(t("nodes")), 12, F.col("line"))


@query("X-20", "SELECT document_id, id, l FROM (SELECT document_id, id, (max_x - min_x) AS l, row_number() OVER (PARTITION BY document_id ORDER BY max_x - min_x DESC, id, layer) AS r FROM {objects}) WHERE r <= 2")
def longest_walls(t, spark):
    own = t("objects").select("document_id", "id", "layer", (F.col("max_x") - F.col("min_x")).alias("l"))
    return ranking.top_per_group(own, ["document_id"], [F.desc("l"), F.col("id"), F.col("layer")], 2).select("document_id", "id", "l")


@query("X-21", "WITH RECURSIVE w(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT e.dst, depth + 1 FROM w JOIN {edges} e ON e.src = w.node WHERE depth < 8) SELECT node, CAST(depth AS INTEGER) AS depth FROM w")
def nested_walk(t, spark):
    """Expansion to a depth of eight at most, as a recursive query."""
    return spark.sql("WITH RECURSIVE w(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT e.dst, depth + 1 FROM w JOIN {edges} e ON e.src = w.node WHERE depth < 8) SELECT node, depth FROM w", edges=t("edges"))


@query("X-24 P-26", "SELECT user_id, count(*) AS tags FROM events GROUP BY 1")
def attribute_maps(t, spark):
    rows = t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tag"), F.col("props").alias("value"))
    return relations.attribute_map(rows).select(F.col("id").alias("user_id"), F.size("attributes").cast("long").alias("tags"))


@query("X-25", "SELECT source, count(*) AS n FROM documents WHERE NOT regexp_matches(source, '^src1') GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, source LIMIT 5")
def evaluation_projects(t, spark):
    own = t("documents").where(~F.col("source").rlike("^src1")).groupBy("source").agg(F.count("*").alias("n")).where("n >= 5")
    return ranking.top_k(own, 5, F.desc("n"), F.col("source"))


@query("X-28", "SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'P'")
def cascade_cleanup(t, spark):
    gone = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    left = contracts.cascade([("lineitem", t("lineitem"), "l_orderkey"), ("orders", t("orders"), "o_orderkey")], gone)
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left]
    return one[0].unionByName(one[1])


@query("X-40", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def visual_evidence_parse(t, spark):
    found = contracts.last_json(F.concat(F.lit('first {"k": 0} then '), F.col("props"), F.lit(" done")))
    return t("events").select("event_id", F.try_variant_get(found, "$.k", "long").alias("k"))


@query("J-28", "SELECT a.id, min(b.id) AS line FROM {marks} a JOIN {frames} b ON abs(a.min_x - b.min_x) <= 5 AND abs(a.min_y - b.min_y) <= 5 GROUP BY 1")
def bubble_lines(t, spark):
    ends = t("frames").select("id", "min_x", "min_y", F.col("min_x").alias("max_x"), F.col("min_y").alias("max_y"))
    near = t("marks").select("id", (F.col("min_x") - 5).alias("min_x"), (F.col("min_y") - 5).alias("min_y"), (F.col("min_x") + 5).alias("max_x"), (F.col("min_y") + 5).alias("max_y"))
    return joins.overlapping(near, ends, 32.0).groupBy("id").agg(F.min("b_id").alias("line"))
