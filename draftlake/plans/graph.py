"""Join, graph, knowledge, spatial, queue, stream and sink queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import identity, spatial, text
from draftlake.operators import blocks, communities, graph, graph_build, jobs, joins, knowledge, ranking, shapes
from draftlake.operators.tables import shared
from draftlake.plans.adapters import query
from draftlake.sinks import text as sinks
from draftlake.streaming import events as streams


@query("J-04", "SELECT o_orderkey, (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_partkey LIMIT 1) AS first_part FROM orders")
def lateral_first_relation(t, spark):
    items = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return joins.first_related(t("orders").select("o_orderkey"), items, "o_orderkey", [F.col("l_linenumber"), F.col("l_partkey")], "l_partkey", "first_part")


@query("J-05 J-16", "SELECT src, dst FROM {edges} WHERE src IN (SELECT id FROM {nodes} WHERE type <> 'Region') AND dst IN (SELECT id FROM {nodes} WHERE type <> 'Region')")
def resolved_relations(t, spark):
    return joins.resolved(t("edges"), t("nodes").where("type != 'Region'"), "src", "dst", "id").select("src", "dst")


@query("J-06 A-18 G-20", "SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS suppliers, count(s_name) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
def storey_rooms(t, spark):
    s = t("supplier").where("s_acctbal > 5000")
    own = t("nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return own.groupBy("n_name").agg(F.nullif(F.array_join(F.array_sort(F.collect_list("s_name")), ","), F.lit("")).alias("suppliers"), F.count("s_name").alias("n"))


@query("J-08 G-24", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE replace(upper(c_mktsegment), ' ', '') = 'MACHINERY')")
def alias_semi_join(t, spark):
    known = t("customer").where(F.replace(F.upper("c_mktsegment"), F.lit(" "), F.lit("")) == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@query("J-09 X-22", "SELECT block, count(*) AS instances FROM {objects} o JOIN (SELECT DISTINCT p_brand FROM part) p ON 'Brand#' || substr(o.block, 2) = p.p_brand GROUP BY block")
def block_instances_of(t, spark):
    brands = t("part").select(F.concat(F.lit("B"), F.regexp_extract("p_brand", r"#(\d+)", 1)).alias("block")).distinct()
    return t("objects").select("block").join(brands, "block").groupBy("block").agg(F.count("*").alias("instances"))


@query("J-10 P-27", "SELECT DISTINCT event_type, unnest(json_keys(props)) AS key FROM events")
def json_attribute_keys(t, spark):
    return t("events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("J-12 S-26", """WITH k AS (SELECT DISTINCT 'H-' || p_size || 'x' || p_partkey % 9 AS key FROM part), d AS (SELECT DISTINCT 'H-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' || p_partkey % 30 END AS name FROM part),
x AS (SELECT name, count(*) AS n, min(key) AS only_key FROM d JOIN k ON starts_with(key, name || 'x') GROUP BY 1)
SELECT d.name, coalesce(k.key, CASE WHEN x.n = 1 THEN x.only_key END) AS key, CASE WHEN k.key IS NOT NULL THEN 'exact' WHEN x.n = 1 THEN 'prefix' ELSE 'none' END AS how FROM d LEFT JOIN k ON k.key = d.name LEFT JOIN x ON x.name = d.name""")
def catalog_prefix_match(t, spark):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    catalog = t("part").select(F.concat(F.lit("H-"), n, F.lit("x"), (k % 9).cast("string")).alias("key")).distinct()
    names = t("part").select(F.concat(F.lit("H-"), n, F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("x"), (k % 30).cast("string")))).alias("name")).distinct()
    return joins.prefix_match(names, catalog, "name", "key").select("name", "key", "how")


@query("J-13 SC-33", """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT d.event_id, c.event_id AS claim FROM d ASOF LEFT JOIN c ON d.user_id = c.user_id AND d.ts >= c.ts""")
def asof_claim_done(t, spark):
    e = t("events").select("user_id", "ts", "event_id", "event_type")
    done, claim = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("claim"))
    return joins.as_of(done, claim, ["user_id"], "ts", "at", "claim", "claim").select("event_id", "claim")


@query("J-14 D-08", "SELECT 'lineitem.part' AS what, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_violations(t, spark):
    a = joins.dangling(t("lineitem"), "l_partkey", t("part").where("p_size <= 25"), "p_partkey").agg(F.count("*").alias("n")).select(F.lit("lineitem.part").alias("what"), "n")
    b = joins.dangling(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey").agg(F.count("*").alias("n")).select(F.lit("orders.customer").alias("what"), "n")
    return a.unionByName(b)


@query("J-15 SK-29", "SELECT o_orderkey, coalesce(max(l_partkey), -1) AS geometry_ref FROM orders LEFT JOIN lineitem ON l_orderkey = coalesce(nullif(o_orderkey, 5), 6) GROUP BY 1")
def objects_geometry(t, spark):
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.max("l_partkey").alias("ref"))
    own = t("orders").select("o_orderkey", F.coalesce(F.nullif("o_orderkey", F.lit(5)), F.lit(6)).alias("source"))
    return own.join(items, "source", "left").select("o_orderkey", F.coalesce("ref", F.lit(-1)).alias("geometry_ref"))


@query("J-33 G-11", """SELECT event_id, CASE WHEN s_suppkey IS NOT NULL THEN 'object' WHEN n_nationkey IS NOT NULL THEN 'drawing' ELSE 'project' END AS subject FROM events LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN nation ON n_nationkey = user_id - 110""")
def rule_subject_ladder(t, spark):
    steps = [("object", t("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("v")), ["user_id"], "v"), ("drawing", t("nation").select((F.col("n_nationkey") + 110).cast("long").alias("user_id"), F.col("n_name").alias("v")), ["user_id"], "v")]
    out = joins.ladder(t("events").select("event_id", "user_id"), steps, "subject")
    return out.select("event_id", F.when(F.col("subject_source") == "(none)", "project").otherwise(F.col("subject_source")).alias("subject"))


@query("J-34", "SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'Door' WHEN 'ring' THEN 'Grid' ELSE NULL END AS canonical FROM part")
def vocabulary_join(t, spark):
    words = spark.createDataFrame([("widget", "Door"), ("ring", "Grid")], "word string, canonical string")  # a fixed vocabulary
    return t("part").select("p_partkey", F.split("p_name", " ")[1].alias("word")).join(F.broadcast(words), "word", "left").select("p_partkey", "canonical")


DIST = "sqrt(greatest(a.min_x - b.max_x, b.min_x - a.max_x, 0) ** 2 + greatest(a.min_y - b.max_y, b.min_y - a.max_y, 0) ** 2)"


@query("J-17 J-22 J-27 W-05 S-53", f"SELECT a.id, arg_min(b.id, ({DIST}, b.id)) AS host, round(min({DIST}), 6) AS distance FROM {{marks}} a JOIN {{frames}} b ON {DIST} <= 12 GROUP BY a.id")
def nearest_host(t, spark):
    return joins.nearest(t("marks"), t("frames"), 12.0, 64.0).withColumn("distance", F.round("distance", 6))


@query("J-25 J-29", f"""WITH p AS (SELECT a.id, b.id AS host, {DIST} AS d FROM {{marks}} a JOIN {{frames}} b ON {DIST} <= 20), x AS (SELECT id, arg_min(host, (d, host)) AS host, min(d) AS d FROM p GROUP BY 1), y AS (SELECT host, arg_min(id, (d, id)) AS id FROM p GROUP BY 1)
SELECT x.id, x.host, round(x.d, 6) AS distance FROM x JOIN y ON x.host = y.host AND x.id = y.id""")
def mutual_nearest(t, spark):
    return joins.mutual_nearest(t("marks"), t("frames"), 20.0, 64.0).withColumn("distance", F.round("distance", 6))


INSIDE = "(a.min_x + a.max_x) / 2 BETWEEN b.min_x AND b.max_x AND (a.min_y + a.max_y) / 2 BETWEEN b.min_y AND b.max_y"


@query("J-19 J-21 J-24", f"SELECT a.id, arg_min(b.id, ((b.max_x - b.min_x) * (b.max_y - b.min_y), b.id)) AS host, min((b.max_x - b.min_x) * (b.max_y - b.min_y)) AS area FROM {{marks}} a JOIN {{frames}} b ON {INSIDE} GROUP BY a.id")
def smallest_container(t, spark):
    return joins.smallest_container(t("marks"), t("frames"), 64.0)


@query("J-26", f"SELECT a.id, min(b.id) AS host FROM {{marks}} a JOIN {{frames}} b ON {INSIDE} GROUP BY a.id HAVING count(*) = 1")
def only_container(t, spark):
    return joins.only_container(t("marks"), t("frames"), 64.0)


@query("J-23 S-53", """WITH p AS (SELECT a.id, b.id AS host, greatest(least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x), 0) * greatest(least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y), 0) AS i,
 (a.max_x - a.min_x) * (a.max_y - a.min_y) + (b.max_x - b.min_x) * (b.max_y - b.min_y) AS s FROM {marks} a JOIN {frames} b ON a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y)
SELECT id, arg_min(host, (-(i / (s - i)), host)) AS host, round(max(i / (s - i)), 6) AS iou FROM p WHERE i / (s - i) >= 0.05 GROUP BY id""")
def iou_match(t, spark):
    return joins.best_overlap(t("marks"), t("frames"), 0.05, 64.0).withColumn("iou", F.round("iou", 6))


@query("S-50 S-51", "SELECT id, round(sqrt(greatest(0.0 - min_x, min_x - 1000.0, 0.0) ** 2 + (min_y - 100.0) ** 2), 6) AS distance, (min_y - 100.0) * (max_y - 100.0) < 0 AND min_x > 0 AND min_x < 1000 AS crosses FROM {frames}")
def segment_geometry(t, spark):
    line = [F.lit(v) for v in (0.0, 100.0, 1000.0, 100.0)]
    d = spatial.point_segment(F.col("min_x"), F.col("min_y"), *line)
    side = [F.col("min_x"), F.col("min_y"), F.col("min_x"), F.col("max_y")]
    return t("frames").select("id", F.round(d, 6).alias("distance"), spatial.crosses(line, side).alias("crosses"))


@query("S-52 J-19", "SELECT id, (max_x - min_x) * (max_y - min_y) AS area, 200 > min_x AND 200 <= max_x AND 205 > min_y AND 205 <= max_y AS inside FROM {frames} WHERE min_x <> 200 AND max_x <> 200 AND min_y <> 205 AND max_y <> 205")
def ring_geometry(t, spark):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("min_x", "min_y"), p("max_x", "min_y"), p("max_x", "max_y"), p("min_x", "max_y"))
    own = t("frames").where("min_x != 200 and max_x != 200 and min_y != 205 and max_y != 205")
    return own.select("id", spatial.ring_area(ring).alias("area"), spatial.in_ring(ring, F.lit(200.0), F.lit(205.0)).alias("inside"))


@query("G-01", """WITH b AS (SELECT src AS node, 'out' AS direction, predicate, dst AS other FROM {edges} UNION ALL SELECT dst, 'in', predicate, src FROM {edges})
SELECT node, direction, predicate, other FROM b WHERE node IN (SELECT id FROM {nodes} WHERE type = 'Nation') QUALIFY row_number() OVER (PARTITION BY node ORDER BY direction DESC, predicate, other) <= 20""")
def relation_expansion(t, spark):
    nations = t("nodes").where("type = 'Nation'").select(F.col("id").alias("node"))
    return graph.expand(nations, t("edges")).select("node", "direction", "predicate", "other")


@query("G-02 T-12", """WITH w AS (SELECT src AS node, predicate, dst AS other, 'out' AS d FROM {edges} UNION ALL SELECT dst, predicate, src, 'in' FROM {edges}), r AS (SELECT id AS root FROM {nodes} WHERE type = 'Supplier'),
o AS (SELECT root, other, predicate, d FROM r JOIN w ON w.node = r.root), h AS (SELECT root, other AS node, 1 AS hop FROM o UNION ALL SELECT o.root, w.other, 2 FROM (SELECT DISTINCT root, other FROM o WHERE NOT (predicate = 'hasCustomer' AND d = 'in')) o JOIN w ON w.node = o.other)
SELECT root, node, min(hop) AS hop FROM h WHERE node <> root GROUP BY 1, 2""")
def kg_khop2(t, spark):
    roots = t("nodes").where("type = 'Supplier'").select(F.col("id").alias("node"))
    return graph.hops(roots, t("edges"), "hasCustomer")


@query("G-03 G-04 J-07", """WITH b AS (SELECT src AS node, 'out' AS direction, predicate, dst AS other FROM {edges} UNION ALL SELECT dst, 'in', predicate, src FROM {edges}),
k AS (SELECT b.*, n.type AS other_type, n.name AS other_name FROM b JOIN {nodes} n ON n.id = b.other QUALIFY row_number() OVER (PARTITION BY node, direction ORDER BY predicate, other) <= 3)
SELECT k.node, m.type, m.name, direction, predicate, other, other_type, other_name FROM k JOIN {nodes} m ON m.id = k.node""")
def kg_explain(t, spark):
    return graph.explain(t("nodes"), t("edges"), 3)


@query("A-16 A-17", "SELECT 'node' AS what, type AS name, count(*) AS n FROM {nodes} GROUP BY 2 UNION ALL SELECT 'edge', predicate, count(*) FROM {edges} GROUP BY 2")
def kg_stats(t, spark):
    return graph.stats(t("nodes"), t("edges"))


def drawn_inserts(t):
    """Model space places regions, which hold nations, which hold a region each again: see INSERTS."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    document, at = (n % 3).alias("document"), lambda x, y, s, turn: (x.alias("x"), y.alias("y"), s.alias("sx"), s.alias("sy"), turn.alias("rotation"))
    region = lambda k: F.concat(F.lit("R"), k)
    top = t("nation").select(document, n.alias("id"), F.lit(None).cast("string").alias("owner"), region(r).alias("block"), *at(n * 10, n % 7, 1 + n % 3, n % 4 * 90))
    each = F.explode(F.sequence(F.lit(0), F.lit(2)))
    held = t("nation").withColumn("document", each).select("document", (n + 100).alias("id"), region(r).alias("owner"), F.concat(F.lit("N"), n).alias("block"), *at(n, n * 2, F.lit(2), (n + 1) % 4 * 90))
    back = t("nation").where(n % 4 == 0).withColumn("document", each).select("document", (n + 200).alias("id"), F.concat(F.lit("N"), n).alias("owner"), region((r + 1) % 5).alias("block"), *at(F.lit(1), n, F.lit(1), F.lit(180)))
    own = top.unionByName(held).unionByName(back)
    return own.select("document", "id", "owner", "block", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "sx", "sy", "rotation")])


INSERTS = """WITH RECURSIVE k AS (SELECT unnest([0, 1, 2]) AS document), i AS (SELECT n_nationkey % 3 AS document, n_nationkey AS id, NULL AS owner, 'R' || n_regionkey AS block, n_nationkey * 10 AS x, n_nationkey % 7 AS y, 1 + n_nationkey % 3 AS s, n_nationkey % 4 * 90 AS rot FROM nation
 UNION ALL SELECT document, n_nationkey + 100, 'R' || n_regionkey, 'N' || n_nationkey, n_nationkey, n_nationkey * 2, 2, (n_nationkey + 1) % 4 * 90 FROM nation, k UNION ALL SELECT document, n_nationkey + 200, 'N' || n_nationkey, 'R' || (n_regionkey + 1) % 5, 1, n_nationkey, 1, 180 FROM nation, k WHERE n_nationkey % 4 = 0),
 m AS (SELECT document, id, owner, block, s * cos(radians(rot)) AS a, s * sin(radians(rot)) AS b, -s * sin(radians(rot)) AS c, s * cos(radians(rot)) AS d, x::DOUBLE AS e, y::DOUBLE AS f FROM i),
 p AS (SELECT document, id AS root, block, a, b, c, d, e, f, [block] AS path, 1 AS depth FROM m WHERE owner IS NULL UNION ALL SELECT p.document, root, m.block, p.a * m.a + p.c * m.b, p.b * m.a + p.d * m.b, p.a * m.c + p.c * m.d, p.b * m.c + p.d * m.d, p.a * m.e + p.c * m.f + p.e, p.b * m.e + p.d * m.f + p.f, list_append(path, m.block), depth + 1 FROM p JOIN m ON m.document = p.document AND m.owner = p.block WHERE depth < 8 AND NOT list_contains(path, m.block))"""


@query("X-21 SC-03", INSERTS + " SELECT CAST(p.document AS INTEGER) AS document, root, s_name AS text, round(a * s_suppkey + c + e, 4) + 0.0 AS x, round(b * s_suppkey + d + f, 4) + 0.0 AS y, CAST(depth AS INTEGER) AS depth FROM p JOIN (SELECT s_name, s_suppkey, 'N' || s_nationkey AS owner FROM supplier) t ON t.owner = p.block")
def nested_block_texts(t, spark):
    """Texts of blocks inside blocks in the world's coordinates."""
    texts = t("supplier").withColumn("document", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("document", F.concat(F.lit("N"), "s_nationkey").alias("owner"), F.col("s_name").alias("text"), F.col("s_suppkey").cast("double").alias("x"), F.lit(1.0).alias("y"))
    inserts = blocks.inserts_of(drawn_inserts(t)).withColumn("document", F.col("document").cast("int"))
    out = blocks.texts_in_world(texts, inserts)
    return out.select("document", "root", "text", *[(F.round(c, 4) + 0.0).alias(c) for c in ("x", "y")], "depth")


@query("X-22 SC-03", INSERTS + """, nm AS (SELECT document, CASE WHEN block LIKE 'N%' THEN 'N' || CAST(substr(block, 2) AS INTEGER) // 5 * 5 ELSE block END AS block, count(*) AS n FROM i GROUP BY ALL), o AS (SELECT document, CASE WHEN owner LIKE 'N%' THEN 'N' || CAST(substr(owner, 2) AS INTEGER) // 5 * 5 ELSE owner END AS owner, CASE WHEN block LIKE 'N%' THEN 'N' || CAST(substr(block, 2) AS INTEGER) // 5 * 5 ELSE block END AS block, count(*) AS n FROM i GROUP BY ALL),
 q AS (SELECT document, block, n, [block] AS path, 1 AS depth FROM o WHERE owner IS NULL UNION ALL SELECT q.document, o.block, q.n * o.n, list_append(path, o.block), depth + 1 FROM q JOIN o ON o.document = q.document AND o.owner = q.block WHERE depth < 8 AND NOT list_contains(path, o.block)), e AS (SELECT document, block, sum(n) AS effective, max(depth) AS deepest FROM q GROUP BY ALL)
SELECT CAST(nm.document AS INTEGER) AS document, nm.block, CAST(nm.n AS BIGINT) AS inserts, CAST(coalesce(effective, 0) AS BIGINT) AS effective, CAST(deepest AS INTEGER) AS deepest FROM nm LEFT JOIN e USING (document, block)""")
def effective_insert_counts(t, spark):
    """Inserts of blocks under the names of their sources, directly and through all nestings."""
    rows = drawn_inserts(t).withColumn("document", F.col("document").cast("int"))
    key = F.substring("block", 2, 9).cast("int")
    names = rows.where("block like 'N%'").select("document", "block").distinct().withColumn("source", F.concat(F.lit("N"), F.floor(key / 5) * 5))
    return blocks.insert_counts(rows, names)


def parts(t) -> graph_build.Parts:
    """The star schema as document parts: see KG for the same in SQL."""
    n = F.col("n")
    docs = t("drawings").select("document_id", "project_key", F.concat(F.lit("Project "), "project_key").alias("project_name"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Stage "), F.col("o_custkey") % 2)).otherwise("").alias("phase"), "name",
                              F.when(F.col("document_id") % 2 == 0, F.col("number")).alias("number"), F.concat(F.lit("Title "), F.col("o_custkey")).alias("title"), text.series_key(F.col("name"), F.lit(None).cast("string")).alias("series"), text.date_token(F.col("name")).alias("date"), F.col("modified").cast("date").cast("string").alias("mtime"), "discipline")
    o = t("objects").select("id", "document_id", "kind", "layout", "label", "state", "category", "n", "storey")
    sheets = o.where(n == 7).select("id", "document_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("S-"), F.col("id") % 100)).alias("number"), F.when(F.col("id") % 5 > 0, F.col("label")).alias("title"), "layout", "label", F.lit("1:100").alias("scale"), "category", F.when(F.col("id") % 3 == 0, F.concat(F.col("id") % 4 + 1, F.lit("F"))).alias("storey"))
    spaces = o.where(n.isin(1, 5)).select("id", "document_id", F.concat(F.lit("Room "), "kind").alias("room"), F.when(F.col("id") % 3 > 0, (F.col("id") % 12).cast("string")).alias("number"), F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("area"), F.nullif("storey", F.lit("")).alias("storey"))
    sections = o.where(n == 2).select("id", "document_id", F.concat(F.lit("h "), F.col("id") % 3 * 50 + 100, F.lit("*50")).alias("designation"))
    members = o.where(n == 3).select("document_id", "kind").join(sections.groupBy("document_id").agg(F.min("id").alias("section")), "document_id")
    return graph_build.Parts(docs, sheets, spaces, o, sections, members)


STAGE = "CASE WHEN o_custkey % 3 = 0 THEN 'Stage ' || o_custkey % 2 END"
#: The document parts, and the graph's own tables over them.
KG = f"""WITH d AS (SELECT document_id, project_key, 'Project ' || project_key AS project_name, {STAGE} AS phase, name, CASE WHEN document_id % 2 = 0 THEN number END AS number, 'Title ' || o_custkey AS title, 't:planx' || o_custkey AS series, regexp_extract(name, '_([0-9]+)', 1) AS date, CAST(modified::DATE AS VARCHAR) AS mtime, discipline FROM {{drawings}}),
 o AS (SELECT * FROM {{objects}}), sh AS (SELECT id, document_id, CASE WHEN id % 2 = 0 THEN 'S-' || id % 100 END AS number, CASE WHEN id % 5 > 0 THEN label END AS title, layout, label, category, CASE WHEN id % 3 = 0 THEN id % 4 + 1 || 'F' END AS level, project_key, project_name FROM o JOIN (SELECT document_id, project_key, project_name FROM d) USING (document_id) WHERE n = 7),
 shown AS (SELECT DISTINCT document_id, level FROM sh WHERE level IS NOT NULL), single AS (SELECT document_id, min(level) AS lone FROM shown GROUP BY 1 HAVING count(*) = 1),
 sp AS (SELECT o.id AS oid, o.document_id, 'Room ' || kind AS room, 'room' || lower(kind) AS room_key, CASE WHEN o.id % 3 > 0 THEN CAST(o.id % 12 AS VARCHAR) END AS number, CASE WHEN o.id % 4 > 0 THEN o.id % 50 END AS area, coalesce(nullif(storey, ''), lone) AS level, project_key, project_name FROM o JOIN d USING (document_id) LEFT JOIN single USING (document_id) WHERE n IN (1, 5)),
 spid AS (SELECT *, 'kg:sp:' || project_key || ':' || coalesce(level, 'NA') || ':' || substr(sha256(room_key), 1, 12) AS id FROM sp),
 eg AS (SELECT 'kg:eg:' || document_id || ':' || kind AS id, document_id, kind, CASE kind WHEN 'Door' THEN '문' WHEN 'Window' THEN '창호' ELSE '벽' END AS ko, project_key, project_name, d.name AS drawing, lone AS level, count(*) AS n, count(*) FILTER (WHERE state = 'OBSERVED') AS observed, list(DISTINCT o.id) AS oids FROM o JOIN d USING (document_id) LEFT JOIN single USING (document_id) GROUP BY ALL),
 se AS (SELECT o.id AS oid, o.document_id, 'h ' || o.id % 3 * 50 + 100 || '*50' AS spelt, 'H-' || o.id % 3 * 50 + 100 || 'x50' AS des, project_key, project_name FROM o JOIN d USING (document_id) WHERE n = 2), seid AS (SELECT *, 'kg:sec:' || project_key || ':' || des AS id FROM se),
 us AS (SELECT o.document_id, o.kind, seid.id AS section_id, 'kg:eg:' || o.document_id || ':' || o.kind AS group_id FROM o JOIN (SELECT document_id, min(oid) AS oid FROM se GROUP BY 1) USING (document_id) JOIN seid USING (oid) WHERE n = 3),
 ch AS (SELECT *, row_number() OVER w AS place, lag('kg:d:' || document_id) OVER w AS before, count(*) OVER (PARTITION BY project_key, series) AS revisions, 'kg:d:' || document_id AS drawing, 'kg:ser:' || project_key || ':' || substr(sha256(series), 1, 12) AS id FROM d WINDOW w AS (PARTITION BY project_key, series ORDER BY date, mtime, name, document_id) QUALIFY revisions > 1),
 st AS (SELECT DISTINCT 'kg:st:' || project_key || ':' || level AS id, project_key, project_name, level FROM (SELECT project_key, project_name, level FROM shown JOIN d USING (document_id) UNION ALL SELECT project_key, project_name, level FROM sp WHERE level IS NOT NULL)),
 """
IDS = "coalesce(array_to_string(list_sort(list_distinct(list({}) FILTER (WHERE {} IS NOT NULL)))[1:20], ','), '')"


@query("G-05 G-06 G-07 G-08 G-09 G-10 A-38 A-39 P-20", KG + f"""titled AS (SELECT document_id, arg_min(number, id) FILTER (WHERE number IS NOT NULL) AS bn, arg_min(title, id) FILTER (WHERE title IS NOT NULL) AS bt, list_sort(list(DISTINCT category)) AS cats FROM sh GROUP BY 1),
 ec AS (SELECT document_id, '{{{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}}}' AS counts FROM eg GROUP BY 1), mk AS (SELECT section_id, '{{{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}}}' AS counts FROM (SELECT section_id, kind, count(*) AS n FROM us GROUP BY ALL) GROUP BY 1),
 ph AS (SELECT DISTINCT project_key, project_name, phase FROM d WHERE phase IS NOT NULL), dc AS (SELECT project_key, '{{{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}}}' AS counts FROM (SELECT project_key, coalesce(discipline, 'UNKNOWN') AS k, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1),
 space_rows AS (SELECT id, project_key, project_name, level, room_key, min(room) AS name, count(*) AS occ, list_sort(list(DISTINCT number) FILTER (WHERE number IS NOT NULL)) AS numbers, (list(area ORDER BY oid) FILTER (WHERE area IS NOT NULL))[1:10] AS areas, {IDS.format('oid', 'oid')} AS oids, {IDS.format('document_id', 'oid')} AS dids FROM spid GROUP BY ALL),
 x AS (SELECT 'kg:p:' || p.project_key AS id, p.project_key, 'Project' AS type, project_name AS name, json_object('drawings', drawings, 'storeys', (SELECT count(*) FROM st WHERE st.project_key = p.project_key), 'spaces', (SELECT count(*) FROM space_rows s WHERE s.project_key = p.project_key), 'sections', (SELECT count(DISTINCT id) FROM seid s WHERE s.project_key = p.project_key), 'phases', (SELECT coalesce(list_sort(list(phase)), []) FROM ph WHERE ph.project_key = p.project_key), 'disciplines', dc.counts::JSON, 'file_types', ('{{{{"dwg":' || drawings || '}}}}')::JSON) AS props, '' AS object_ids, dids AS document_ids, '' AS words
   FROM (SELECT project_key, project_name, count(*) AS drawings, {IDS.format('document_id', 'document_id')} AS dids FROM d GROUP BY ALL) p JOIN dc USING (project_key)
 UNION ALL SELECT 'kg:ph:' || project_key || ':' || substr(sha256(phase), 1, 10), project_key, 'Phase', phase, json_object('project', project_name), '', '', '' FROM ph
 UNION ALL SELECT 'kg:d:' || document_id, d.project_key, 'Drawing', d.name, json_object('sheet_number', d.number, 'title', d.title, 'date', d.date, 'discipline', d.discipline, 'phase', d.phase, 'mtime', d.mtime, 'file_type', 'dwg', 'sheet_number_titleblock', bn, 'title_titleblock', bt, 'categories', coalesce(cats, []), 'element_counts', counts::JSON, 'series_latest', place = revisions), '', CAST(document_id AS VARCHAR),
   '도면 ' || concat_ws(' ', d.number, d.title, bt, CASE d.discipline WHEN 'ARCH' THEN '건축' WHEN 'STRUCT' THEN '구조' WHEN 'MECH' THEN '기계' END, d.phase, array_to_string(cats, ' ')) FROM d LEFT JOIN titled USING (document_id) LEFT JOIN ec USING (document_id) LEFT JOIN (SELECT document_id, place, revisions FROM ch) USING (document_id)
 UNION ALL SELECT id, project_key, 'DrawingSeries', arg_max(coalesce(number, title), place), json_object('series_key', series, 'revisions', revisions, 'latest', arg_max(drawing, place)), '', array_to_string((list(document_id ORDER BY place))[1:20], ','), '' FROM ch GROUP BY id, project_key, project_name, series, revisions
 UNION ALL SELECT 'kg:sh:' || id, project_key, 'Sheet', coalesce(nullif(concat_ws(' ', number, title), ''), layout), json_object('layout', layout, 'number', number, 'title', title, 'scale', '1:100', 'category', category, 'storey', level), CAST(id AS VARCHAR), CAST(document_id AS VARCHAR), '시트 도곽 ' || layout || ' ' || category FROM sh
 UNION ALL SELECT st.id, st.project_key, 'Storey', st.level, json_object('level', st.level, 'order', [1, CAST(left(st.level, length(st.level) - 1) AS INTEGER)], 'project', st.project_name), '', {IDS.format('s.document_id', 's.document_id')}, '층' FROM st LEFT JOIN (SELECT 'kg:st:' || project_key || ':' || level AS id, document_id FROM shown JOIN d USING (document_id)) s ON s.id = st.id GROUP BY st.id, st.project_key, st.level, st.project_name
 UNION ALL SELECT id, project_key, 'Space', name, json_object('room_key', room_key, 'storey', level, 'areas', coalesce(areas, []), 'room_numbers', coalesce(numbers, []), 'occurrences', occ), oids, dids, '실 공간 ' || concat_ws(' ', level, array_to_string(numbers, ' ')) FROM space_rows
 UNION ALL SELECT id, project_key, 'ElementGroup', drawing || ' ' || ko, json_object('kind', kind, 'kind_ko', ko, 'count', n, 'observed', observed, 'drawing', drawing, 'storey', level), array_to_string(list_sort(oids)[1:20], ','), CAST(document_id AS VARCHAR), concat_ws(' ', ko, level) FROM eg
 UNION ALL SELECT id, project_key, 'SteelSection', des, json_object('designation', des, 'occurrences', count(*), 'member_kinds', any_value(counts)::JSON), {IDS.format('oid', 'oid')}, {IDS.format('document_id', 'oid')}, '철골 형강 단면' FROM seid LEFT JOIN mk ON section_id = id GROUP BY id, project_key, project_name, des)
SELECT id, project_key, type, name, CAST(props AS VARCHAR) AS props, object_ids, document_ids, trim(regexp_replace(type || ' ' || name || ' Project ' || project_key || ' ' || words, '\\s+', ' ', 'g')) AS search_text FROM x""")
def kg_nodes(t, spark):
    out = graph_build.build(parts(t), ("nodes",)).nodes
    return out.select("id", "project_key", "type", "name", "props", *[F.array_join(c, ",").alias(c) for c in ("object_ids", "document_ids")], "search_text")


@query("G-05 G-06 G-07 G-08 G-09 G-10 A-38 A-39", KG + """e AS (SELECT 'kg:p:' || project_key AS src, 'hasDrawing' AS predicate, 'kg:d:' || document_id AS dst, '{{}}' AS props FROM d
 UNION ALL SELECT DISTINCT 'kg:p:' || project_key, 'hasPhase', 'kg:ph:' || project_key || ':' || substr(sha256(phase), 1, 10), '{{}}' FROM d WHERE phase IS NOT NULL UNION ALL SELECT 'kg:ph:' || project_key || ':' || substr(sha256(phase), 1, 10), 'hasDrawing', 'kg:d:' || document_id, '{{}}' FROM d WHERE phase IS NOT NULL
 UNION ALL SELECT 'kg:d:' || document_id, 'hasSheet', 'kg:sh:' || id, '{{}}' FROM sh UNION ALL SELECT 'kg:sh:' || id, 'depictsStorey', 'kg:st:' || project_key || ':' || level, '{{}}' FROM sh WHERE level IS NOT NULL
 UNION ALL SELECT id, 'hasRevision', drawing, '{{"order":' || place - 1 || '}}' FROM ch UNION ALL SELECT drawing, 'supersedes', before, '{{"by":"date"}}' FROM ch WHERE before IS NOT NULL
 UNION ALL SELECT 'kg:p:' || project_key, 'hasStorey', id, '{{}}' FROM st UNION ALL SELECT 'kg:d:' || document_id, 'depictsStorey', 'kg:st:' || project_key || ':' || level, '{{}}' FROM shown JOIN d USING (document_id)
 UNION ALL SELECT DISTINCT 'kg:d:' || document_id, 'depictsSpace', id, '{{}}' FROM spid UNION ALL SELECT DISTINCT 'kg:st:' || project_key || ':' || level, 'hasSpace', id, '{{}}' FROM spid WHERE level IS NOT NULL
 UNION ALL SELECT 'kg:d:' || document_id, 'hasElements', id, '{{}}' FROM eg UNION ALL SELECT 'kg:st:' || project_key || ':' || level, 'hasElements', id, '{{}}' FROM eg WHERE level IS NOT NULL
 UNION ALL SELECT DISTINCT 'kg:d:' || document_id, 'usesSection', id, '{{}}' FROM seid UNION ALL SELECT DISTINCT 'kg:p:' || project_key, 'usesSection', id, '{{}}' FROM seid UNION ALL SELECT DISTINCT group_id, 'hasSection', section_id, '{{}}' FROM us) SELECT * FROM e""")
def kg_edges(t, spark):
    return graph_build.build(parts(t), ("edges",)).edges


@query("G-05 G-06 G-10 S-37", KG + """a AS (SELECT 'project_id' AS alias_type, project_key AS alias, 'kg:p:' || project_key AS node_id FROM d UNION ALL SELECT 'project_name', project_name, 'kg:p:' || project_key FROM d UNION ALL SELECT 'sheet_number', number, 'kg:d:' || document_id FROM d WHERE number IS NOT NULL
 UNION ALL SELECT 'sheet_number', number, 'kg:sh:' || id FROM sh WHERE number IS NOT NULL UNION ALL SELECT 'room_name', room, id FROM spid UNION ALL SELECT 'section', spelt, id FROM seid) SELECT DISTINCT * FROM a""")
def kg_aliases(t, spark):
    return graph_build.build(parts(t), ("aliases",)).aliases


@query("W-02 G-07 G-26", """SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, lag(o_orderkey) OVER w AS supersedes, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_latest FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def revision_chain(t, spark):
    out = graph.chain(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "place", "supersedes", "is_latest")


@query("G-12 D-07 ST-14", """WITH n AS (SELECT project_key, sha256(string_agg(name, chr(10) ORDER BY name)) AS f FROM {drawings} GROUP BY 1), b AS (SELECT project_key, CASE WHEN project_key < 'P3' THEN 'old' ELSE f END AS g FROM n WHERE project_key <> 'P7' UNION ALL SELECT 'gone', 'x')
SELECT coalesce(n.project_key, b.project_key) AS project_key, CASE WHEN f IS NULL THEN 'removed' WHEN g IS NULL THEN 'new' WHEN f = g THEN 'unchanged' ELSE 'changed' END AS action FROM n FULL JOIN b ON n.project_key = b.project_key""")
def kg_fingerprint_skip(t, spark):
    rows = t("drawings").select("project_key", "name")
    built = rows.where("project_key != 'P7'").groupBy("project_key").agg(identity.fingerprint(F.col("name")).alias("fingerprint")).withColumn("fingerprint", F.when(F.col("project_key") < "P3", "old").otherwise(F.col("fingerprint")))
    built = built.unionByName(spark.createDataFrame([("gone", "x")], "project_key string, fingerprint string"))
    return knowledge.changed(rows, built, "project_key", F.col("name")).select("project_key", "action")


JOINED = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), chr(10))"
COMMUNITY = KG + f"""titled AS (SELECT document_id, arg_min(title, id) FILTER (WHERE title IS NOT NULL) AS bt FROM sh GROUP BY 1),
 dr AS (SELECT document_id, project_key, project_name, coalesce(discipline, 'UNKNOWN') AS code, CASE discipline WHEN 'ARCH' THEN '건축' WHEN 'STRUCT' THEN '구조' WHEN 'MECH' THEN '기계' END AS ko, coalesce(number, '~') AS k1, name AS k2, 'kg:d:' || document_id AS k3,
   '도면: ' || concat_ws(' ', number, title) || ' (' || array_to_string(list_filter([ko, phase, date], lambda x: x IS NOT NULL), ', ') || ')' AS fact FROM d),
 spn AS (SELECT id, project_key, level, min(room) AS name, (list(area ORDER BY oid) FILTER (WHERE area IS NOT NULL))[1] AS area FROM spid GROUP BY ALL), stl AS (SELECT id, project_key, project_name, des, count(*) AS occ FROM seid GROUP BY ALL),
 mk AS (SELECT section_id, string_agg(CASE kind WHEN 'Door' THEN '문' WHEN 'Window' THEN '창호' ELSE '벽' END || ' ' || n, ', ' ORDER BY kind) AS uses FROM (SELECT section_id, kind, count(*) AS n FROM us GROUP BY ALL) GROUP BY 1),
 pk AS (SELECT project_key, string_agg(ko || ' ' || n, ', ' ORDER BY n DESC, kind) AS f FROM (SELECT project_key, kind, ko, sum(n) AS n FROM eg GROUP BY ALL) GROUP BY 1), sk AS (SELECT project_key, level, string_agg(ko || ' ' || n, ', ' ORDER BY n DESC, kind) AS f FROM (SELECT project_key, level, kind, ko, sum(n) AS n FROM eg WHERE level IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 pd AS (SELECT project_key, string_agg(coalesce(ko, '미분류') || ' ' || n, ', ' ORDER BY n DESC, code) AS f FROM (SELECT project_key, code, ko, count(*) AS n FROM dr GROUP BY ALL) GROUP BY 1), ps AS (SELECT project_key, string_agg(level, ', ' ORDER BY CAST(left(level, length(level) - 1) AS INTEGER)) AS f FROM st GROUP BY 1),
 pr AS (SELECT project_key, array_to_string((list(name ORDER BY n DESC, name))[1:25], ', ') AS f FROM (SELECT project_key, name, count(*) AS n FROM spn GROUP BY ALL) GROUP BY 1), pt AS (SELECT project_key, array_to_string((list(des || '(' || occ || ')' ORDER BY occ DESC, des))[1:15], ', ') AS f FROM stl GROUP BY 1),
 pp AS (SELECT project_key, string_agg(DISTINCT phase, ', ' ORDER BY phase) AS f FROM d WHERE phase IS NOT NULL GROUP BY 1), pl AS (SELECT project_key, project_name, count(*) AS n, array_to_string((list(fact ORDER BY k1, k2, k3))[1:40], chr(10)) AS f FROM dr GROUP BY ALL),
 sr AS (SELECT project_key, level, count(*) AS n, array_to_string((list(name || coalesce('(' || area || '㎡)', '') ORDER BY name, id))[1:40], ', ') AS f FROM spn WHERE level IS NOT NULL GROUP BY ALL), sd AS (SELECT project_key, level, count(*) AS n, array_to_string((list(fact ORDER BY k1, k2, k3))[1:30], chr(10)) AS f FROM shown JOIN dr USING (document_id) GROUP BY ALL),
 c AS (SELECT 'kgc:' || pl.project_key || ':0' AS id, pl.project_key, 0 AS level, project_name || ' 프로젝트 개요' AS title, 1 AS members, {JOINED.format("'프로젝트: ' || project_name, '도면 수: ' || pl.n, '단계 폴더: ' || pp.f, '공종별 도면 수: ' || pd.f, '파일 형식: dwg ' || pl.n, '층: ' || ps.f, '주요 실: ' || pr.f, '도면 요소 수(후보 포함): ' || pk.f, '철골 단면: ' || pt.f, pl.f")} AS facts
   FROM pl LEFT JOIN pp USING (project_key) LEFT JOIN pd USING (project_key) LEFT JOIN ps USING (project_key) LEFT JOIN pr USING (project_key) LEFT JOIN pk USING (project_key) LEFT JOIN pt USING (project_key)
  UNION ALL SELECT 'kgc:' || project_key || ':1:disc:' || code, project_key, 1, project_name || ' ' || coalesce(ko, '미분류') || ' 도면', count(*), '프로젝트: ' || project_name || chr(10) || coalesce(ko, '미분류') || ' 도면 ' || count(*) || '건' || chr(10) || array_to_string((list(fact ORDER BY k1, k2, k3))[1:78], chr(10)) FROM dr GROUP BY project_key, project_name, code, ko HAVING count(*) >= 2
  UNION ALL SELECT 'kgc:' || st.project_key || ':1:storey:' || st.level, st.project_key, 1, project_name || ' ' || st.level, 1 + coalesce(sr.n, 0) + coalesce(sd.n, 0), {JOINED.format("'프로젝트: ' || project_name, '층: ' || st.level, '실: ' || sr.f, '요소 수(후보 포함): ' || sk.f, sd.f")} FROM st LEFT JOIN sr ON sr.project_key = st.project_key AND sr.level = st.level LEFT JOIN sk ON sk.project_key = st.project_key AND sk.level = st.level LEFT JOIN sd ON sd.project_key = st.project_key AND sd.level = st.level
  UNION ALL SELECT 'kgc:' || project_key || ':1:steel', project_key, 1, project_name || ' 철골 단면', count(*), '프로젝트: ' || project_name || chr(10) || '철골 단면 ' || count(*) || '종' || chr(10) || string_agg('단면 ' || des || ': 표기 ' || occ || '회' || coalesce(', 부재 ' || uses, ''), chr(10) ORDER BY occ DESC, des) FROM stl LEFT JOIN mk ON section_id = id GROUP BY project_key, project_name)"""


@query("G-13 X-34 G-16", COMMUNITY + " SELECT id, project_key, CAST(level AS INTEGER) AS level, title, members, facts, sha256('prompt-1' || chr(10) || facts) AS input_hash FROM c")
def communities_rule(t, spark):
    own = graph_build.build(parts(t), ("facts",))
    return knowledge.communities(own.facts, own.edges).select("id", "project_key", "level", "title", "members", F.array_join("facts", "\n").alias("facts"), "input_hash")


@query("G-15 G-16", COMMUNITY + " SELECT id, CASE WHEN id LIKE 'kgc:P1%' THEN 'new' WHEN id LIKE '%:MECH' THEN 'changed' ELSE 'unchanged' END AS status FROM c")
def community_refresh_status(t, spark):
    own = graph_build.build(parts(t), ("facts",))
    now = shared(knowledge.communities(own.facts, own.edges).select("id", "input_hash"), "communities")
    before = now.where(~F.startswith("id", F.lit("kgc:P1"))).withColumn("input_hash", F.when(F.endswith("id", F.lit(":MECH")), "old").otherwise(F.col("input_hash")))
    return knowledge.refresh(now, before)


@query("G-14")
def modularity_communities(t, spark):
    """Suppliers that deliver to the same nations' orders, grouped by modularity: nation to supplier, weighted by line items."""
    lines = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    to = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    edges = to.groupBy("c_nationkey", "l_suppkey").agg(F.sum("n").alias("weight"))
    edges = edges.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), "weight")
    return communities.modularity(edges)


@query("G-14")
def label_communities(t, spark):
    """Label propagation, a cheaper way than modularity and another algorithm: rows only."""
    return graph.label_propagation(t("edges").where("predicate != 'hasCustomer'"), 4)


@query("G-17", "SELECT DISTINCT conv_id, c.w AS name FROM conversations v JOIN (VALUES ('the'), ('der'), ('les'), ('los')) c(w) ON contains(' ' || lower(text) || ' ', ' ' || c.w || ' ')")
def entity_link(t, spark):
    names = F.explode(F.filter(F.array(*map(F.lit, ("the", "der", "les", "los"))), lambda w: F.contains(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))))
    return t("conversations").select("conv_id", names.alias("name")).distinct()


@query("G-31 P-19", """WITH x AS (SELECT document_id AS cid, arg_min(id, (block IS NULL, id)) AS object_id FROM {objects} GROUP BY 1) SELECT cid, object_id, name FROM x LEFT JOIN {drawings} d ON d.document_id = x.cid""")
def ask_citations(t, spark):
    objects = t("objects").select("id", "document_id", F.when(F.col("block").isNotNull(), F.col("min_x")).alias("min_x"))
    items = objects.groupBy("document_id").agg(F.collect_list("id").alias("object_ids")).withColumn("cid", F.col("document_id"))
    return knowledge.citations(items, objects, t("drawings").select("document_id", "name")).select("cid", "object_id", "name")


@query("G-22 G-21 G-23", "SELECT project_key, kind, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM (SELECT d.project_key, o.kind, o.document_id, count(*) AS n FROM {objects} o JOIN {drawings} d USING (document_id) WHERE d.document_id NOT IN (SELECT document_id FROM {drawings} WHERE category = 'detail') GROUP BY 1, 2, 3) GROUP BY 1, 2")
def element_counts_template(t, spark):
    superseded = t("drawings").where("category = 'detail'").select("document_id")
    each = t("objects").join(t("drawings").select("document_id", "project_key"), "document_id").join(superseded, "document_id", "left_anti").groupBy("project_key", "kind", "document_id").agg(F.count("*").alias("n"))
    return each.groupBy("project_key", "kind").agg(F.max("n").alias("most"), F.sum("n").alias("total"))


@query("G-25 T-10", "SELECT document_id, name FROM {drawings} WHERE name ILIKE '%plan x12%' ORDER BY length(name), name, document_id LIMIT 20")
def drawings_template(t, spark):
    own = t("drawings").where(text.like_literal(F.col("name"), "plan x12")).select("document_id", "name")
    return ranking.top_k(own, 20, F.length("name"), F.col("name"), F.col("document_id"))


@query("A-40 G-33", """WITH i AS (SELECT project_key, storey, n FROM {objects} JOIN {drawings} USING (document_id)) SELECT project_key, max(TRY_CAST(regexp_extract(storey, '^([0-9]+)F$', 1) AS INTEGER)) AS above, CAST(NULL AS INTEGER) AS below, string_agg(DISTINCT 'H-' || n, ',' ORDER BY 'H-' || n) AS sections FROM i GROUP BY 1""")
def project_facts(t, spark):
    own = t("objects").select("document_id", "storey", "n").join(t("drawings").select("document_id", "project_key"), "document_id")
    return knowledge.project_facts(own.select("project_key", F.col("storey").alias("level")), own.select("project_key", F.concat(F.lit("H-"), F.col("n").cast("string")).alias("designation")))


@query("G-37", "WITH c AS (SELECT c_custkey AS subject, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer) SELECT subject, 'orders' AS predicate, n FROM c WHERE n < 1 OR n > 5")
def shacl_cardinality(t, spark):
    triples = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject"), F.lit("orders").alias("predicate"))
    return graph.cardinality(t("customer").select(F.col("c_custkey").alias("subject")), triples, "orders", 1, 5)


@query("G-37 D-17", "SELECT c_custkey AS subject, 'segment' AS predicate, c_mktsegment AS object, 'pattern' AS why FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[A-G]')")
def shacl_value_shapes(t, spark):
    triples = t("customer").select(F.col("c_custkey").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"))
    return graph.shape(triples, "segment", F.col("object").rlike("^[A-G]"), "pattern")


@query("G-37", """WITH c AS (SELECT 'c' || c_custkey AS f, c_custkey AS k, c_nationkey AS n, c_acctbal AS b FROM customer), s AS (SELECT 's' || s_suppkey AS f, s_suppkey AS k, s_nationkey AS n FROM supplier),
 v AS (SELECT 'CAIRObjectShape' AS shape, f AS focus, 'aec:sourceFile' AS path, NULL AS value, 'minCount' AS why FROM c WHERE k % 7 = 0 UNION ALL SELECT 'CAIRObjectShape', f, 'aec:projectId', NULL, 'maxCount' FROM c WHERE k % 11 = 0 UNION ALL SELECT 'CAIRObjectShape', f, 'aec:projectId', 'P' || n, 'datatype' FROM c WHERE k % 5 = 0
  UNION ALL SELECT 'CAIRObjectShape', f, 'aec:classificationConfidence', CAST(k % 13 AS VARCHAR), 'maxInclusive' FROM c WHERE k % 13 > 1 UNION ALL SELECT 'CAIRObjectShape', f, 'aec:classificationState', 'UNKNOWN', 'in' FROM c WHERE k % 3 = 0 UNION ALL SELECT 'CAIRObjectShape', f, 'aec:hasGeometry', 'geom ' || k, 'nodeKind' FROM c WHERE k % 4 = 0
  UNION ALL SELECT 'OnStoreyShape', f, 'aec:onStorey', NULL, 'maxCount' FROM c WHERE k % 2 = 0 UNION ALL SELECT 'OnStoreyShape', f, 'aec:onStorey', 'n' || n, 'class' FROM c WHERE n % 3 = 0 UNION ALL SELECT 'OnStoreyShape', f, 'aec:onStorey', 'x' || n, 'class' FROM c WHERE k % 2 = 0
  UNION ALL SELECT 'SteelMemberShape', f, 'aec:hasSection', NULL, 'minCount' FROM s WHERE k % 5 = 0 UNION ALL SELECT 'SteelMemberShape', f, 'aec:hasSection', 'sec' || k, 'class' FROM s WHERE k % 5 > 0 AND k % 2 = 1
  UNION ALL SELECT 'SteelSectionShape', 'sec' || k, 'aec:sectionDesignation', 'X' || k, 'pattern' FROM s WHERE k % 5 > 0 AND k % 2 = 0 AND k % 3 = 0) SELECT * FROM v""")
def shape_violations(t, spark):
    """Customers as objects on storeys, suppliers as members of steel: every violation of every shape in one plan."""
    n, k, m = F.col("n_nationkey"), F.col("c_custkey"), F.col("s_suppkey")
    fact = lambda rows, ok, s, p, o, kind="literal", datatype="xsd:string": rows.where(ok).select(s.alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(datatype) if isinstance(datatype, str) or datatype is None else datatype).alias("datatype"))
    c, s, yes = t("customer"), t("supplier"), F.lit(True)
    me, you, section = F.concat(F.lit("c"), k), F.concat(F.lit("s"), m), F.concat(F.lit("sec"), m)
    project, nation = F.concat(F.lit("P"), "c_nationkey"), F.concat(F.lit("n"), "c_nationkey")
    iri = lambda rows, ok, x, p, o: fact(rows, ok, x, p, o, "IRI", None)
    rows = [
        fact(c, yes, me, "aec:projectId", project, "literal", F.when(k % 5 == 0, "xsd:integer").otherwise("xsd:string")), fact(c, k % 11 == 0, me, "aec:projectId", F.lit("second")), fact(c, k % 7 != 0, me, "aec:sourceFile", F.lit("f.dwg")),
        fact(c, yes, me, "aec:classificationConfidence", k % 13, "literal", "xsd:decimal"), fact(c, yes, me, "aec:classificationState", F.when(k % 3 == 0, "UNKNOWN").otherwise("AUTO_ACCEPT")),
        fact(c, yes, me, "aec:hasGeometry", F.concat(F.lit("geom "), k), F.when(k % 4 == 0, "literal").otherwise("IRI"), None), iri(c, yes, me, "aec:onStorey", nation), iri(c, k % 2 == 0, me, "aec:onStorey", F.concat(F.lit("x"), "c_nationkey")),
        iri(t("nation"), n % 3 != 0, F.concat(F.lit("n"), n), "rdf:type", F.when(n % 3 == 1, "aec:Storey").otherwise("aec:Basement")),
        iri(s, yes, you, "rdf:type", F.lit("aec:Column")), iri(s, m % 5 > 0, you, "aec:hasSection", section), iri(s, (m % 5 > 0) & (m % 2 == 0), section, "rdf:type", F.lit("aec:SteelSection")), fact(s, (m % 5 > 0) & (m % 2 == 0), section, "aec:sectionDesignation", F.when(m % 3 == 0, F.concat(F.lit("X"), m)).otherwise(F.concat(F.lit("H-"), m))),
    ]
    known = spark.createDataFrame([("aec:Basement", "aec:Underground"), ("aec:Underground", "aec:Storey"), ("aec:Column", "aec:SteelMember")], "sub string, super string")
    return shapes.violations(reduce(DataFrame.unionByName, rows), known)


@query("G-38", "SELECT count(*) > 0 AS has_orders, count(*) FILTER (WHERE o_custkey IS NULL) = 0 AS all_owned, count(DISTINCT o_orderkey) = count(*) AS unique_keys FROM orders")
def repository_audit(t, spark):
    return t("orders").agg((F.count("*") > 0).alias("has_orders"), (F.count_if(F.col("o_custkey").isNull()) == 0).alias("all_owned"), (F.countDistinct("o_orderkey") == F.count("*")).alias("unique_keys"))


@query("G-42", "SELECT doc_id, unnest(CASE WHEN n_chars > 5000 THEN ['scan', 'split', 'index'] ELSE ['scan', 'index'] END) AS stage FROM documents WHERE lang IN ('en', 'de')")
def ingestion_plan(t, spark):
    stages = F.when(F.col("n_chars") > 5000, F.array(*map(F.lit, ("scan", "split", "index")))).otherwise(F.array(*map(F.lit, ("scan", "index"))))
    return t("documents").where(F.col("lang").isin("en", "de")).select("doc_id", F.explode(stages).alias("stage"))


@query("G-43", "SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS INTEGER) AS choice, p_type FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def typed_choices(t, spark):
    return t("part").select("p_type", "p_brand").distinct().withColumn("choice", F.row_number().over(Window.partitionBy("p_type").orderBy("p_brand")))


@query("G-50 X-06", """WITH e AS (SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS payload, event_id % 17 = 0 AS broken FROM events) SELECT log, seq, NOT broken AS sound FROM e""")
def evidence_log_replay(t, spark):
    w = Window.partitionBy("log").orderBy("seq")
    e = t("events").select(F.col("user_id").alias("log"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.col("event_type").alias("payload"), (F.col("event_id") % 17 == 0).alias("broken"))
    e = e.withColumn("previous", F.coalesce(F.lag("payload").over(w), F.lit("")))
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "payload", "previous"), 256)
    return graph.replay(e.withColumn("digest", F.when(F.col("broken"), "x").otherwise(own))).select("log", "seq", "sound")


@query("T-06 ST-02", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY coalesce(nullif(o_custkey % 5, 0), 100), o_orderdate DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 100")
def queue_claim_order(t, spark):
    own = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "QUEUED").otherwise("SUCCEEDED").alias("state"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("priority"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("created_at"))
    return jobs.order(own).limit(100).select("id")


@query("ST-01", "WITH r AS (SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) SELECT event_id FROM r WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def enqueue_dedup(t, spark):
    requests = t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("dedup_key"), F.col("ts").alias("created_at"))
    return jobs.enqueue(t("supplier").select(F.col("s_suppkey").alias("dedup_key")), requests).select(F.col("id").alias("event_id"))


@query("ST-02 ST-03 ST-04")
def queue_state_fold(t, spark):
    """State of each job after its events; rows only, a fold has no SQL form."""
    event = F.element_at(F.array(*map(F.lit, ("claim", "heartbeat", "finish", "fail", "retry"))), (F.col("event_id") % 5 + 1).cast("int"))
    own = t("events").select((F.col("user_id") % 50).alias("job_id"), event.alias("event"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("owner"), F.unix_timestamp("ts").cast("double").alias("at"), F.col("event_id").alias("seq"))
    return jobs.fold(own, 86400.0)


@query("A-35 ST-12", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_throughput(t, spark):
    return jobs.hourly(t("events"), "ts")


@query("ST-12", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(t, spark):
    return streams.tumbling(t("events"), "ts", "6 hours", ["event_type"]).withColumn("total", F.round("total", 4))


@query("ST-12", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - to_hours(k) AS start, count(*) AS n FROM events, (VALUES (0), (1), (2)) s(k) GROUP BY 1")
def sliding_events(t, spark):
    return streams.sliding(t("events"), "ts", "3 hours", "1 hour")


@query("ST-12", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '4 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def session_events(t, spark):
    return streams.sessions(t("events"), "ts", "4 hours", "user_id")


@query("ST-13", "SELECT doc_id, arg_max(quality, doc_id) AS quality FROM labels GROUP BY 1")
def review_revisions(t, spark):
    return t("labels").groupBy("doc_id").agg(F.max_by("quality", "doc_id").alias("quality"))


@query("SK-02", """SELECT '{{"@id":"' || id || '","@type":"' || type || '","name":"' || name || '"}}' AS line FROM {nodes}""")
def jsonld_rows(t, spark):
    return sinks.jsonld_nodes(t("nodes"))


@query("SK-05 SK-07 SK-13", """SELECT '<' || id || '> <name> "' || name || '" .' AS line FROM {nodes}""")
def turtle_rows(t, spark):
    return sinks.turtle(t("nodes").select(F.col("id").alias("s"), F.lit("name").alias("p"), F.col("name").alias("o"), F.lit(True).alias("literal")))


@query("SK-10 SK-11", """SELECT 'MERGE (n:' || type || ' {{id: "' || id || '"}}) SET n.name = "' || name || '";' AS line FROM {nodes} UNION ALL SELECT 'MATCH (a {{id: "' || src || '"}}), (b {{id: "' || dst || '"}}) MERGE (a)-[:' || predicate || ']->(b);' FROM {edges}""")
def cypher_seed(t, spark):
    return sinks.cypher_nodes(t("nodes")).unionByName(sinks.cypher_edges(t("edges")))


@query("SK-03", """SELECT '<node id="' || id || '"><data key="type">' || type || '</data></node>' AS line FROM {nodes} UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="predicate">' || predicate || '</data></edge>' FROM {edges}""")
def graphml_rows(t, spark):
    return sinks.graphml(t("nodes"), t("edges")).where("part in (1, 2)").select("line")


@query("SK-04", "SELECT id, type, name FROM {nodes} WHERE id IN (SELECT src FROM {edges})")
def graph_tables(t, spark):
    return t("nodes").join(t("edges").select(F.col("src").alias("id")), "id", "left_semi").select("id", "type", "name")


@query("SK-25", "SELECT '| ' || c_mktsegment || ' | ' || count(*) FILTER (WHERE c_acctbal >= 0) || ' | ' || count(*) FILTER (WHERE c_acctbal < 0) || ' |' AS line FROM customer GROUP BY c_mktsegment")
def markdown_matrix(t, spark):
    own = t("customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") >= 0).alias("plus"), F.count_if(F.col("c_acctbal") < 0).alias("minus"))
    return sinks.markdown(own, "c_mktsegment", ["plus", "minus"])
