"""Catalogue, aggregation, window, paging, dedup and diff queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftlake.operators import catalog, dedup, diff, jobs, joins, ranking, tables, validation
from draftlake.functions import identity
from draftlake.plans.adapters import query


@query("A-06", "SELECT kind, count(*) AS objects, count(DISTINCT document_id) AS documents, count(*) FILTER (WHERE state = 'AI_INFERRED') AS inferred FROM {objects} GROUP BY kind")
def element_catalog_kinds(t, spark):
    return catalog.kinds(t("objects"))


@query("A-07", "SELECT category, CAST(sum(o) AS BIGINT) AS objects, max(d) AS documents, count(*) AS kinds FROM (SELECT category, kind, count(*) AS o, count(DISTINCT document_id) AS d FROM {objects} GROUP BY 1, 2) GROUP BY category")
def category_kind_rollup(t, spark):
    return catalog.category_rollup(t("objects"))


@query("A-08", "SELECT project_id, count(DISTINCT document_id) AS documents, count(*) AS objects FROM {objects} GROUP BY 1")
def project_rollup(t, spark):
    return catalog.projects(t("objects"))


@query("A-09", "SELECT predicate, count(*) AS n FROM {edges} GROUP BY 1")
def predicate_histogram(t, spark):
    return catalog.histogram(t("edges"), "predicate")


@query("A-10", "SELECT layer, CAST(sum(n) AS BIGINT) AS objects, string_agg(kind || '=' || n, ';' ORDER BY kind) AS kinds FROM (SELECT layer, kind, count(*) AS n FROM {objects} GROUP BY 1, 2) GROUP BY layer ORDER BY objects DESC, layer LIMIT 200")
def layer_kind_map(t, spark):
    return catalog.layer_kinds(t("objects")).withColumn("kinds", F.array_join(F.transform("kinds", lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ";"))


@query("A-11", "SELECT count(block) AS inserts, count(DISTINCT block) AS blocks, count(DISTINCT document_id) FILTER (WHERE block IS NOT NULL) AS documents, count(*) FILTER (WHERE block IS NOT NULL AND state = 'OBSERVED') AS observed FROM {objects}")
def block_totals(t, spark):
    return catalog.block_totals(t("objects"))


@query("A-12", "SELECT storey, count(*) AS n FROM {objects} WHERE storey <> '' GROUP BY 1")
def storey_histogram(t, spark):
    return catalog.histogram(t("objects"), "storey")


@query("A-13 W-05", """WITH e AS (SELECT block, kind, count(*) AS n FROM {objects} WHERE block IS NOT NULL GROUP BY 1, 2)
SELECT o.block, count(*) AS inserts, CAST(count(DISTINCT document_id) AS INTEGER) AS documents, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers,
 (SELECT kind FROM e WHERE e.block = o.block ORDER BY n DESC, kind DESC LIMIT 1) AS main_kind FROM {objects} o WHERE o.block IS NOT NULL GROUP BY o.block""")
def block_instances(t, spark):
    return catalog.block_instances(t("objects"))


@query("A-14", "SELECT document_id, layout, kind, count(*) AS n FROM {objects} GROUP BY 1, 2, 3")
def sheet_element_counts(t, spark):
    return catalog.sheet_counts(t("objects"))


@query("A-15 D-18", "SELECT document_id, kind, count(*) AS objects, count(*) FILTER (WHERE state = 'OBSERVED') AS observed, array_to_string(list_sort(list(id))[1:20], ',') AS evidence FROM {objects} GROUP BY 1, 2")
def element_group_evidence(t, spark):
    out = catalog.element_groups(t("objects"))
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("F-06 F-07 T-04", "SELECT id, kind, layer, block FROM {objects} WHERE kind = 'Door' AND layer ILIKE 'a-o-%' AND lower(block) = 'b7' AND id > 1000000000 ORDER BY id LIMIT 51")
def find_elements_page(t, spark):
    what = catalog.ElementFilter(kind="Door", layer="a-o-*", block="b7")
    return catalog.find(t("objects").select("id", "kind", "layer", "block"), what, after=1000000000, size=50)


@query("F-09", "SELECT id FROM {objects} WHERE min_x <= 120 AND 100 <= max_x AND min_y <= 60 AND 40 <= max_y")
def bbox_overlap(t, spark):
    return t("objects").where(catalog.ElementFilter(window=(100, 40, 120, 60)).condition()).select("id")


@query("F-10", """WITH h AS (SELECT o.id FROM {objects} o WHERE o.category = 'plan' OR EXISTS (SELECT 1 FROM {objects} v WHERE v.kind = 'View' AND v.category = 'plan' AND v.document_id = o.document_id AND v.layout = o.layout)
 OR EXISTS (SELECT 1 FROM {drawings} d WHERE d.document_id = o.document_id AND d.category = 'plan')) SELECT id FROM {objects} WHERE id IN (SELECT id FROM h)""")
def category_filter_semi(t, spark):
    return catalog.in_category(t("objects"), t("drawings"), "plan").select("id")


@query("F-13", "SELECT id, kind FROM {objects} WHERE state = 'AI_INFERRED' AND project_id = 'P3' ORDER BY id, kind LIMIT 100")
def review_candidates(t, spark):
    return ranking.top_k(t("objects").where("state = 'AI_INFERRED' and project_id = 'P3'").select("id", "kind"), 100, F.col("id"), F.col("kind"))


@query("F-14", "SELECT id FROM {objects} WHERE lower(kind) = 'door' AND project_id = 'P2' AND confidence >= 0.9")
def registry_find(t, spark):
    return t("objects").where((F.lower("kind") == "door") & (F.col("project_id") == "P2") & (F.col("confidence") >= 0.9)).select("id")


@query("F-26", "SELECT event_id FROM events WHERE extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 7")
def time_window_filter(t, spark):
    return t("events").where((F.hour("ts") >= 22) | (F.hour("ts") < 7)).select("event_id")


@query("A-01 SK-23", "SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def census_totals(t, spark):
    return t("documents").groupingSets([("source",), ("lang",), ()], "source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("A-02 D-11", "SELECT sha256(text) AS content, count(*) AS copies, count(*) - 1 AS redundant, (count(*) - 1) * max(n_chars) AS redundant_bytes, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedup_groups(t, spark):
    return dedup.groups(t("documents"), F.sha2("text", 256), "doc_id", F.col("n_chars"))


@query("D-11 T-07 P-23", "SELECT sha256(text) AS content, min(doc_id) AS canonical, count(*) - 1 AS aliases, max(n_chars) AS newest FROM documents GROUP BY 1")
def canonical_plan(t, spark):
    return dedup.plan(t("documents"), F.sha2("text", 256), "doc_id", "n_chars")


@query("D-12 J-37", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY n_chars, md5(text) ORDER BY doc_id) AS representative FROM documents")
def duplicate_representatives(t, spark):
    own = t("documents").withColumn("md5", F.md5("text"))
    return dedup.representatives(own, ["n_chars", "md5"], [F.col("doc_id")], "doc_id").select("doc_id", "representative")


@query("D-13 F-11 F-12 ST-09", """SELECT sha256(text) AS content_hash, count(*) AS carriers FROM documents WHERE text <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN embeddings ON doc_id = vec_id) GROUP BY 1""")
def text_dedup_embed_plan(t, spark):
    known = t("documents").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.sha2("text", 256).alias("content_hash")).distinct()
    return dedup.embed_plan(t("documents"), known, "text")


@query("D-14", "SELECT vec_id FROM embeddings WHERE label > 3 AND vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(t, spark):
    return dedup.orphans(t("embeddings").select("vec_id", "label"), t("labels").select(F.col("doc_id").alias("vec_id")), ["vec_id"], F.col("label") > 3).select("vec_id")


@query("D-15", "WITH r AS (SELECT user_id, event_type AS model FROM events) SELECT user_id, model, count(*) AS n FROM r WHERE model <> 'click' AND user_id IN (SELECT user_id FROM r WHERE model = 'click') GROUP BY 1, 2")
def stale_models(t, spark):
    rows = t("events").select("user_id", F.col("event_type").alias("model"))
    return dedup.stale_models(rows, "user_id", "click").groupBy("user_id", "model").agg(F.count("*").alias("n"))


@query("D-16", "SELECT n_chars, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def legacy_id_collisions(t, spark):
    return dedup.collisions(t("documents"), "n_chars", "source")


@query("SK-15 SK-14 W-08", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, label FROM embeddings")
def keyed_upsert(t, spark):
    return dedup.upsert(t("labels").select("doc_id", "quality"), t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("quality")), ["doc_id"])


@query("D-10", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def context_dedupe(t, spark):
    return dedup.first_seen(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("W-01 J-03", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""")
def latest_job_per_document(t, spark):
    last = ranking.latest(t("orders").where("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")
    return t("customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("W-03", "SELECT o_custkey, o_orderkey, printf('V%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS iteration FROM orders")
def iteration_sequence(t, spark):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", F.format_string("V%03d", n).alias("iteration"))


@query("W-06", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events QUALIFY next_event IS NOT NULL")
def consecutive_segments(t, spark):
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", nxt.alias("next_event")).where("next_event is not null")


@query("W-09", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def running_header(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t("events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query("W-11 SK-32", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3")
def backup_rotation(t, spark):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("n")).where("n > 3").drop("n")


@query("T-05", "SELECT DISTINCT block FROM {objects} WHERE block > 'B15' ORDER BY block LIMIT 11")
def keyset_names(t, spark):
    return ranking.keyset_page(t("objects").where("block is not null").select("block").distinct(), "block", "B15", 10)


@query("T-11", """WITH b AS (SELECT src AS node, 'out' AS direction, predicate, dst AS other FROM {edges} UNION ALL SELECT dst, 'in', predicate, src FROM {edges})
SELECT node, direction, other FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY direction DESC, predicate, other) <= 20""")
def relation_budget(t, spark):
    from draftlake.operators import graph

    nodes = t("nodes").select(F.col("id").alias("node"))
    return graph.expand(nodes, t("edges"), 20).select("node", "direction", "other")


@query("T-16", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def seeded_sample(t, spark):
    return ranking.seeded_sample(t("documents").select("doc_id"), "doc_id", 7, 25)


@query("A-03 SK-25", """SELECT project_id, count(*) FILTER (WHERE kind = 'Door') AS "Door", count(*) FILTER (WHERE kind = 'Wall') AS "Wall", count(*) FILTER (WHERE kind = 'Window') AS "Window" FROM {objects} GROUP BY 1""")
def project_kind_matrix(t, spark):
    return t("objects").groupBy("project_id").pivot("kind", ["Door", "Wall", "Window"]).agg(F.count("id")).na.fill(0)


@query("A-04", "SELECT o_orderstatus AS state, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def queue_summary(t, spark):
    return t("orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("A-05", """SELECT substr(regexp_replace(regexp_replace(url, '(/[^\\s]+)+', '<path>', 'g'), '[0-9a-f]{{8,}}|\\d+', '<n>', 'g'), 1, 120) AS failure, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, failure LIMIT 5""")
def failure_messages(t, spark):
    return jobs.failures(t("pages"), "url", 5)


@query("A-20 D-02", """WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT event_type, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (event_type)""")
def type_count_delta(t, spark):
    split = F.lit("2024-01-10").cast("timestamp")
    return diff.counts(t("events").where(F.col("ts") < split), t("events").where(F.col("ts") >= split), "event_type")


@query("D-01 J-38", """WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, max(o_totalprice) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, max(o_totalprice) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT k AS o_custkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'deleted' WHEN a.s <> b.s OR a.p <> b.p THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (k)""")
def snapshot_diff(t, spark):
    split = F.lit("1997-01-01").cast("timestamp")
    a, b = (t("orders").where(c).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"), F.max("o_totalprice").alias("p")) for c in (F.col("o_orderdate") < split, F.col("o_orderdate") >= split))
    return diff.snapshots(a, b, "o_custkey", ["s", "p"])


@query("D-01 P-18", """WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, max(o_totalprice) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderstatus) AS s, max(o_totalprice) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT k AS o_custkey, a.s <> b.s AS reclassified, a.p <> b.p AS moved FROM a JOIN b USING (k)""")
def snapshot_facets(t, spark):
    split = F.lit("1997-01-01").cast("timestamp")
    a, b = (t("orders").where(c).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"), F.max("o_totalprice").alias("p")) for c in (F.col("o_orderdate") < split, F.col("o_orderdate") >= split))
    return diff.facets(a, b, "o_custkey", {"reclassified": ["s"], "moved": ["p"]})


@query("D-03 X-18 SC-34", """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 < 8), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 > 1)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (doc_id)) GROUP BY 1""")
def code_snapshot_diff(t, spark):
    rows = t("documents").select("doc_id", F.md5("text").alias("h"))
    old = rows.where("doc_id % 10 < 8")
    new = rows.where("doc_id % 10 > 1").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    return diff.snapshots(old, new, "doc_id", ["h"]).groupBy("change").agg(F.count("*").alias("n"))


@query("D-09 A-41", """WITH m AS (SELECT user_id, event_type, count(*) FILTER (WHERE value < 50) AS a, count(*) FILTER (WHERE value >= 50) AS b FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || ':' || a || '/' || b, ',' ORDER BY event_type) AS differences FROM m WHERE a <> b GROUP BY 1""")
def count_map_diff(t, spark):
    each = t("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") < 50).alias("a"), F.count_if(F.col("value") >= 50).alias("b"))
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("b"))
    found = F.array_sort(F.map_entries(diff.map_difference(F.col("a"), F.col("b"))))
    text = F.array_join(F.transform(found, lambda e: F.concat(e["key"], F.lit(":"), e["value"]["a"].cast("string"), F.lit("/"), e["value"]["b"].cast("string"))), ",")
    return maps.select("user_id", text.alias("differences")).where("differences <> ''")


@query("A-24", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS p95 FROM s")
def percentile_round_rank(t, spark):
    return ranking.at_rank(t("events"), "event_type", "value", ranking.percentile_round(0.95)).select("event_type", F.col("value").alias("p95"))


@query("A-25", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[CAST(ceil(0.95::DOUBLE * len(v)) AS INTEGER)] AS p95 FROM s")
def percentile_ceil_rank(t, spark):
    return ranking.at_rank(t("events"), "event_type", "value", ranking.percentile_ceil(0.95)).select("event_type", F.col("value").alias("p95"))


@query("A-26", "SELECT event_type, median(value) AS median_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def median_mean(t, spark):
    return t("events").groupBy("event_type").agg(F.median("value").alias("median_value"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("A-21 SK-24", "SELECT count(*) AS objects, count(DISTINCT document_id) AS documents, round(avg(coalesce(confidence, 0)), 6) AS confidence FROM {objects}")
def dashboard_metrics(t, spark):
    return validation.dashboard(t("objects"), F.col("confidence")).withColumn("confidence", F.round("confidence", 6))


@query("A-22 A-23", """WITH s AS (SELECT avg(CASE WHEN kind IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS classified, avg(CASE WHEN document_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS provenance, avg(CASE WHEN min_x IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS geometry, avg(CASE WHEN block IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS layered FROM {objects})
SELECT round(classified, 6) AS classified, round(provenance, 6) AS provenance, round(geometry, 6) AS geometry, round(layered, 6) AS layered, round((classified + provenance + geometry + layered) / 4, 6) AS score,
 CASE WHEN (classified + provenance + geometry + layered) / 4 >= 0.9 THEN 'PASS' WHEN (classified + provenance + geometry + layered) / 4 >= 0.7 THEN 'WARN' ELSE 'FAIL' END AS status FROM s""")
def ingest_quality_scores(t, spark):
    out = validation.ingest_scores(t("objects").withColumn("layer", F.col("block")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns[:-1]], "status")


@query("A-32", """WITH e AS (SELECT layer, document_id, count(*) AS n FROM {objects} GROUP BY 1, 2)
SELECT layer, count(*) AS drawings, CAST(sum(n) AS BIGINT) AS entities, max(n) AS most_in_one FROM e GROUP BY 1 ORDER BY entities DESC, layer LIMIT 1000""")
def layer_overview(t, spark):
    return catalog.names_overview(t("objects"), "layer")


@query("A-33", """WITH e AS (SELECT document_id, kind AS discipline, count(*) AS votes FROM {objects} GROUP BY 1, 2), s AS (SELECT document_id, sum(votes) AS total, max(votes) AS top FROM e GROUP BY 1 HAVING sum(votes) >= 5)
SELECT s.document_id, (SELECT discipline FROM e WHERE e.document_id = s.document_id ORDER BY votes DESC, discipline DESC LIMIT 1) AS discipline, round(least(0.8::DOUBLE, 0.5::DOUBLE + 0.3::DOUBLE * top / total), 6) AS confidence FROM s""")
def layer_vote_discipline(t, spark):
    votes = t("objects").groupBy("document_id", F.col("kind").alias("discipline")).agg(F.count("*").alias("votes"))
    return catalog.vote(votes).withColumn("confidence", F.round("confidence", 6))


@query("A-34 X-32", "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS fingerprint FROM orders GROUP BY 1")
def member_fingerprint(t, spark):
    return t("orders").groupBy("o_custkey").agg(identity.fingerprint(F.col("o_orderkey").cast("string")).alias("fingerprint"))


@query("A-36", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def storage_report(t, spark):
    one = lambda n: t(n).select(F.lit(n).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return one("orders").unionByName(one("lineitem")).unionByName(one("documents"))


@query("A-42 J-31 ST-10 X-23", """WITH d AS (SELECT document_id, min(nullif(storey, '')) AS s FROM {objects} WHERE kind = 'Door' AND state = 'OBSERVED' GROUP BY 1), w AS (SELECT document_id, min(nullif(storey, '')) AS s FROM {objects} WHERE kind = 'Wall' GROUP BY 1)
SELECT CASE WHEN d.s IS NOT NULL THEN 'door' WHEN w.s IS NOT NULL THEN 'wall' ELSE '(none)' END AS storey_source, count(*) AS n FROM {drawings} g LEFT JOIN d USING (document_id) LEFT JOIN w USING (document_id) GROUP BY 1""")
def storey_backfill_sources(t, spark):
    first = lambda c: t("objects").where(c).groupBy("document_id").agg(F.min(F.nullif("storey", F.lit(""))).alias("s"))
    steps = [("door", first("kind = 'Door' and state = 'OBSERVED'"), ["document_id"], "s"), ("wall", first("kind = 'Wall'"), ["document_id"], "s")]
    return joins.ladder(t("drawings").select("document_id"), steps, "storey").groupBy("storey_source").agg(F.count("*").alias("n"))


@query("P-07 SK-28", "SELECT id AS object_id, unnest(['FreeCAD', 'Blender', 'QGIS']) AS application, 'REFERENCE_ONLY' AS status FROM {objects}")
def application_mappings(t, spark):
    return tables.application_mappings(t("objects"))


@query("P-05", """SELECT event_id AS object_id, 'type' AS property_name, '{{"value":"' || event_type || '"}}' AS value_json FROM events UNION ALL SELECT event_id, 'user', '{{"value":"' || user_id || '"}}' FROM events""")
def properties_table(t, spark):
    own = t("events").select(F.col("event_id").alias("id"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("properties"))
    return tables.properties_table(own)


@query("P-01 P-10 S-27 S-61", """SELECT n_nationkey, '{{"name":"' || n_name || '","region":' || n_regionkey || '}}' AS nested_json FROM nation""")
def objects_json(t, spark):
    own = t("nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nested"))
    return tables.objects_table(own)


@query("P-14 P-15 P-23", "SELECT s_suppkey, 'rel_' || sha256(s_name || '|locatedIn|' || s_nationkey) AS relation_id, substr(sha256(s_name || chr(31) || s_nationkey), 1, 16) AS short FROM supplier")
def relation_ids(t, spark):
    return t("supplier").select("s_suppkey", identity.relation_id(F.col("s_name"), F.lit("locatedIn"), F.col("s_nationkey").cast("string")).alias("relation_id"), identity.short_hash(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("short"))


@query("P-17 S-61", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events")
def json_path_coalesce(t, spark):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.coalesce(F.try_variant_get(v, "$.missing", "long"), F.try_variant_get(v, "$.k", "long")).alias("k"))


@query("F-25", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0")
def valid_vectors(t, spark):
    from draftlake.functions.similarity import usable_vector

    return t("embeddings").where(usable_vector(F.col("embedding"), 64)).select("vec_id")


@query("F-22 F-23 F-24 P-25 G-51", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 100000 THEN NULL ELSE 'price' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'status' END) AS problems,
 CASE WHEN o_orderpriority = '1-URGENT' AND (o_totalprice > 100000 OR o_orderstatus NOT IN ('F', 'O')) THEN 'REVIEW' WHEN o_orderpriority = '1-URGENT' THEN 'PASS' ELSE 'OTHER' END AS outcome FROM orders""")
def rule_authority(t, spark):
    found = validation.problems({"price": F.col("o_totalprice") <= 100000, "status": F.col("o_orderstatus").isin("F", "O")})
    own = t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "PASS").otherwise("OTHER").alias("o"), found.alias("p"))
    return own.select("o_orderkey", F.array_join("p", ",").alias("problems"), validation.demoted(F.col("o"), F.col("p"), F.lit(False)).alias("outcome"))


@query("F-21", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'error')")
def active_evidence(t, spark):
    own = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", F.array(F.col("event_id") - 1)).otherwise(F.array().cast("array<long>")).alias("supersedes"))
    return validation.active(own).select(F.col("id").alias("event_id"))


@query("A-43", """WITH e AS (SELECT user_id AS capability, event_type AS kind, date_trunc('day', ts) AS d, CASE WHEN value >= 50 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM events),
l AS (SELECT * FROM e QUALIFY d = max(d) OVER (PARTITION BY capability, kind)), k AS (SELECT capability, kind, max(outcome) AS outcome, count(DISTINCT outcome) AS outcomes FROM l GROUP BY 1, 2)
SELECT capability, CASE WHEN max(outcomes) > 1 THEN 'CONFLICTED' WHEN count(*) FILTER (WHERE outcome = 'FAIL') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE outcome = 'PASS') > 0 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS state, count(*) AS kinds FROM k GROUP BY 1""")
def capability_states(t, spark):
    own = t("events").select(F.col("user_id").alias("capability"), F.col("event_type").alias("kind"), F.date_trunc("day", "ts").alias("observed"), F.when(F.col("value") >= 50, "PASS").otherwise("FAIL").alias("outcome"))
    return validation.capability_state(own)


@query("X-03", "SELECT source, CASE WHEN count(DISTINCT lang) > 1 THEN 'CONFLICTED' WHEN count(DISTINCT lang) = 0 THEN 'UNKNOWN' ELSE 'CONFIRMED' END AS state FROM documents GROUP BY 1")
def license_projection(t, spark):
    return t("documents").groupBy("source").agg(validation.license_state(F.col("lang")).alias("state"))


@query("X-02", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'REVOKED' WHEN ts < TIMESTAMP '2024-01-05' THEN 'STALE' WHEN ts > TIMESTAMP '2024-01-25' THEN 'FUTURE' ELSE 'CURRENT' END AS freshness FROM events")
def evidence_freshness(t, spark):
    day = lambda d: F.lit(d).cast("timestamp")
    state = validation.freshness(F.col("event_type") == "error", F.when(F.col("ts") < day("2024-01-05"), day("2024-01-01")).otherwise(day("2024-02-01")), F.col("ts"), day("2024-01-25"))
    return t("events").select("event_id", state.alias("freshness"))


@query("G-45 X-14 X-31", """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE md5(text) END AS h FROM documents WHERE doc_id % 6 <> 0)
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b USING (doc_id)""")
def inventory_verification(t, spark):
    rows = t("documents").select("doc_id", F.md5("text").alias("h"))
    remote = rows.where("doc_id % 6 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("h")))
    return validation.compare_inventory(rows.where("doc_id % 5 <> 0"), remote, "doc_id", "h")
