"""Text-rule, search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftlake.functions import identity, similarity, text
from draftlake.operators import knowledge, ranking, rules, search, tables
from draftlake.plans.adapters import query
from draftlake.sources import files

TOKENS = "list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'))"
QUESTION = "the table of contents and a report on that system"


@query("S-38 S-44 T-02 G-35", f"""WITH q AS (SELECT {TOKENS.replace('text', repr(QUESTION))} AS q), d AS (SELECT doc_id, source, {TOKENS} AS tok FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id, source AS project, round(least(1.0::DOUBLE, (2 * len(list_intersect(q, tok)) + len(list_intersect(q, [source])))::DOUBLE / greatest(2 * len(q), 1)), 6) AS score FROM d, q
WHERE 2 * len(list_intersect(q, tok)) + len(list_intersect(q, [source])) > 0 ORDER BY score DESC, project, id LIMIT 20""")
def memory_topk(t, spark):
    """Portable memory retrieval: question tokens against object tokens and the project's."""
    objects = t("documents").select(F.col("doc_id").alias("id"), F.col("source"), F.col("text").alias("body"))
    return search.memory(objects, "source", QUESTION, 20).withColumn("score", F.round("score", 6))


@query("D-06 G-34 T-03", """WITH f AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')) AS feature FROM documents), s AS (SELECT source, count(*) AS n FROM f GROUP BY 1),
c AS (SELECT a.source AS project, b.source AS other, count(*) AS common FROM f a JOIN f b ON a.feature = b.feature AND a.source < b.source GROUP BY 1, 2)
SELECT project, other, round(common::DOUBLE / (x.n + y.n - common), 6) AS score FROM c JOIN s x ON x.source = project JOIN s y ON y.source = other ORDER BY common::DOUBLE / (x.n + y.n - common) DESC, project, other LIMIT 50""")
def similar_sources_jaccard(t, spark):
    own = t("documents").select(F.col("source").alias("project"), F.explode(text.token_set(F.col("text"))).alias("feature"))
    return search.similar_projects(own, 50).withColumn("score", F.round("score", 6))


@query("S-45", """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')) AS tok FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(sha256(tok), 1, 16))::UBIGINT % 64 AS INTEGER) AS k, count(*) AS n FROM w GROUP BY 1, 2), z AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM b GROUP BY 1)
SELECT doc_id, k, round(n / norm, 8) AS value FROM b JOIN z USING (doc_id)""")
def hash_vector64(t, spark):
    own = t("documents").select("doc_id", similarity.hash_vector(F.col("text")).alias("v"))
    return own.select("doc_id", F.posexplode("v").alias("k", "value")).where("value > 0")


@query("S-46")
def hash_vector1024(t, spark):
    """Signed hash vectors with their squared norms; rows only, as SQL has not the white space and lower case of all scripts."""
    own = t("documents").select("doc_id", similarity.signed_hash_vector(F.col("text")).alias("vector"))
    return own.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))


@query("S-39", """SELECT doc_id, round(((length(lower(text)) - length(replace(lower(text), 'the', '')))::DOUBLE / 3 + (length(lower(text)) - length(replace(lower(text), 'ation', '')))::DOUBLE / 5) / (1 + length(text)::DOUBLE / 400), 6) AS score FROM documents""")
def keyword_score(t, spark):
    return t("documents").select("doc_id", F.round(similarity.keyword_score(F.col("text"), ["the", "ation"]), 6).alias("score"))


@query("S-42 G-28 F-19", """WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'idiot') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'rights') AS INTEGER) AS hits FROM documents)
SELECT doc_id, hits FROM s WHERE hits > 0 AND hits * 2 >= (SELECT max(hits) FROM s) ORDER BY hits DESC, doc_id LIMIT 50""")
def knowledge_hits(t, spark):
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ("license", "rights")), F.contains(F.lower("text"), F.lit("idiot")).cast("int"))
    own = t("documents").select("doc_id", hits.alias("hits"))
    top = own.agg(F.max("hits").alias("top"))  # one row
    return own.join(F.broadcast(top), (F.col("hits") > 0) & (F.col("hits") * 2 >= F.col("top"))).orderBy(F.desc("hits"), "doc_id").limit(50).select("doc_id", "hits")


@query("G-48 J-36", """WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+') AS tok FROM documents), s AS (SELECT count(*) AS n, avg(len(tok)) AS a FROM k),
f AS (SELECT doc_id, len(tok) AS dl, t.w, len(list_filter(tok, lambda x: x = t.w)) AS tf FROM k, (VALUES ('idiot'), ('license'), ('tion')) t(w)), d AS (SELECT w, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))), 6) AS score FROM f JOIN d USING (w), s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 25""")
def bm25_topk(t, spark):
    own = search.bm25(t("documents"), "doc_id", "text", ["idiot", "license", "tion"]).withColumn("score", F.round("score", 6))
    return ranking.top_k(own, 25, F.desc("score"), F.col("doc_id"))


GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[0-9a-z가-힣]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("S-40 F-04 T-09", f"""WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {GRAMS.format('p_name')} AS t FROM n), q AS (SELECT {GRAMS.format("'red widget'")} AS t)
SELECT p_name, round(len(list_intersect(q.t, g.t))::DOUBLE / len(q.t), 6) AS bound FROM g, q WHERE len(list_intersect(q.t, g.t)) > 0 ORDER BY bound DESC, p_name LIMIT 40""")
def trigram_bound_topk(t, spark):
    own = t("part").select("p_name").distinct().withColumn("bound", F.round(similarity.trigram_bound(F.lit("red widget"), F.col("p_name")), 6)).where("bound > 0")
    return ranking.top_k(own, 40, F.desc("bound"), F.col("p_name"))


SEQUENCE = "flatten(list_transform(regexp_extract_all(lower({}), '[0-9a-z가-힣]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
#: The similarity of wanted trigrams t to the best extent of a sequence s, over all extents.
EXTENT = "coalesce(list_max(flatten(list_transform(range(1, len(s) + 1), lambda a: list_transform(range(a, len(s) + 1), lambda z: len(list_intersect(s[a:z], t))::DOUBLE / (len(t) + len(list_distinct(s[a:z])) - len(list_intersect(s[a:z], t))))))), 0)"


@query("S-40 F-04 G-29", f"""WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT {GRAMS.format("'red widgt'")} AS t), m AS (SELECT p_name, {SEQUENCE.format('p_name')} AS s, t FROM n, q)
SELECT p_name, round({EXTENT}, 6) AS similarity FROM m WHERE {EXTENT} > 0.3::DOUBLE ORDER BY 2 DESC, 1 LIMIT 20""")
def word_similarity_topk(t, spark):
    """Exact extent similarity behind the native bound."""
    own = search.fuzzy(t("part").select("p_name").distinct(), "p_name", "red widgt", 0.3)
    return own.select("p_name", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "p_name").limit(20)


@query("S-40 F-04 T-09", f"""WITH l AS (SELECT DISTINCT p_name || ' ' || p_brand AS label FROM part), q AS (SELECT DISTINCT p_name AS query_id, left(p_name, 3) || substr(p_name, 5) AS query FROM part),
 g AS (SELECT query_id, {GRAMS.format('query')} AS t FROM q), k AS (SELECT label, {SEQUENCE.format('label')} AS s FROM l), m AS (SELECT query_id, label, {EXTENT} AS v FROM g, k WHERE len(list_intersect(s, t)) >= 0.6::DOUBLE * len(t) - 1e-9)
SELECT query_id, label, round(v, 6) AS similarity FROM m WHERE v >= 0.6::DOUBLE""")
def fuzzy_label_join(t, spark):
    """Every part name, misspelt, against all labels: one join over the trigram index."""
    labels = t("part").select(F.concat_ws(" ", "p_name", "p_brand").alias("label")).distinct()
    asked = t("part").select(F.col("p_name").alias("query_id")).distinct().withColumn("query", F.concat(F.substring("query_id", 1, 3), F.substring("query_id", 5, 100)))
    index = search.gram_index(labels.withColumn("name", F.col("label")), "label", "name")
    return search.fuzzy_join(asked, index, "label", 0.6).select("query_id", "label", F.round("similarity", 6).alias("similarity"))


SEED = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


@query("F-03 F-05 S-41 S-48 T-01 J-01 J-02", f"""WITH o AS (SELECT doc_id AS id, source AS label, CASE WHEN lang = 'en' THEN 'Wall' ELSE 'Annotation' END AS kind,
 (CAST(contains(lower(text), 'idiot') AS DOUBLE) + CAST(contains(lower(text), 'license') AS DOUBLE)) / 2 AS lexical, list_cosine_similarity(embedding::DOUBLE[], {SEED}) AS vector FROM documents JOIN embeddings ON doc_id = vec_id)
SELECT id, label, kind, round(0.6::DOUBLE * lexical + 0.4::DOUBLE * vector + CASE WHEN kind <> 'Annotation' THEN 0.05::DOUBLE ELSE 0 END, 6) AS score FROM o WHERE lexical > 0 OR vector > 0.4
ORDER BY score DESC, label, id LIMIT 30""")
def hybrid_search_topk(t, spark):
    seed = t("embeddings").where("vec_id = 7").select(F.col("embedding").alias("seed"))  # one row
    own = t("documents").join(t("embeddings"), F.col("doc_id") == F.col("vec_id")).join(F.broadcast(seed))
    lexical, vector = similarity.contained_score(F.col("text"), ["idiot", "license"]), similarity.cosine(F.col("embedding"), F.col("seed"))
    own = own.select(F.col("doc_id").alias("id"), F.col("source").alias("label"), F.when(F.col("lang") == "en", "Wall").otherwise("Annotation").alias("kind"), lexical.alias("lexical"), vector.alias("vector"))
    own = own.where("lexical > 0 or vector > 0.4").withColumn("score", F.round(similarity.hybrid_score(F.col("lexical"), F.col("vector"), ~F.col("kind").isin(*search.GENERIC_KINDS)), 6))
    return ranking.top_k(own.select("id", "label", "kind", "score"), 30, F.desc("score"), F.col("label"), F.col("id"))


@query("S-49 D-04 J-35", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY r LIMIT 100), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings ORDER BY r LIMIT 100)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""")
def rrf_fusion(t, spark):
    def ranked(df, key, *order):
        top = df.orderBy(*order).limit(100)  # a hundred rows: one task ranks them
        return top.select(F.col(key).alias("doc_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))

    lists = [ranked(t("documents"), "doc_id", F.desc("n_chars"), F.col("doc_id")), ranked(t("embeddings"), "vec_id", F.col("label"), F.col("vec_id"))]
    own = ranking.fused(lists, "doc_id").withColumn("score", F.round("score", 6))
    return ranking.top_k(own, 50, F.desc("score"), F.col("doc_id"))


@query("T-08 S-47", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {SEED}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {SEED}) DESC, vec_id LIMIT 20")
def knn_exact(t, spark):
    seed = t("embeddings").where("vec_id = 7").select(F.col("embedding").alias("seed"))  # one row
    own = t("embeddings").join(F.broadcast(seed)).select("vec_id", similarity.cosine(F.col("embedding"), F.col("seed")).alias("similarity"))
    return ranking.top_k(own, 20, F.desc("similarity"), F.col("vec_id")).withColumn("similarity", F.round("similarity", 6))


@query("F-05 T-08", """SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 5""")
def knn_batch(t, spark):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return search.knn_batch(q, v, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("A-28 A-27 W-04", """WITH r AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS bl, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
f AS (SELECT q, min(rank) FILTER (WHERE ql = bl) AS first_rank FROM r WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS cases, round(avg(CASE WHEN first_rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM f""")
def hit_at_k_mrr(t, spark):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    labels = t("embeddings").select("vec_id", "label")
    ranked = search.knn_batch(q, v, 10).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    out = ranking.hit_rates(ranking.first_hit(ranked, "query_id", F.col("own") == F.col("label")))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_5", "hit_10", "mrr")])


@query("A-30 E-08", """WITH p AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS e, CASE WHEN n_chars < 60 THEN NULL WHEN contains(text, '!!') OR contains(text, '%%%') THEN 'bad' ELSE 'good' END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT l AS label, count(*) FILTER (WHERE e = l AND p = l) AS tp, count(*) FILTER (WHERE p = l AND e <> l) AS fp, count(*) FILTER (WHERE e = l AND (p IS NULL OR p <> l)) AS fn FROM p, (VALUES ('good'), ('bad')) v(l) GROUP BY 1)
SELECT label, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def prf_by_class(t, spark):
    own = t("labels").join(t("documents"), "doc_id")
    noisy = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("%%%"))
    pairs = own.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("e"), F.when(F.col("n_chars") < 60, F.lit(None)).when(noisy, "bad").otherwise("good").alias("p"))
    out = ranking.precision_recall(pairs, "e", "p")
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("A-31", "SELECT source, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def extraction_accuracy(t, spark):
    own = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return own.groupBy("source").agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("n"))


@query("A-28 G-44", """WITH r AS (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
g AS (SELECT a.vec_id AS q, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT g.q AS query_id, round(count(r.id)::DOUBLE / count(*), 6) AS recall FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r ON r.q = g.q AND r.id = g.id GROUP BY 1""")
def knn_label_recall(t, spark):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    labels = t("embeddings").select("vec_id", "label")
    gold = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(labels.select(F.col("vec_id").alias("id"), "label"), "label").where("id != query_id").select("query_id", "id")
    return ranking.recall_at(search.knn_batch(q, v, 50), gold, "query_id", "id", 50).withColumn("recall", F.round("recall", 6))


@query("S-29 P-22", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', ' ', 'g'), '\\+?[0-9]{{2,4}}[- ][0-9]{{3,4}}[- ][0-9]{{4}}', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS clean FROM documents""")
def pii_scrub(t, spark):
    return t("documents").select("doc_id", text.scrub(F.col("text")).alias("clean"))


@query("S-22 S-21", """SELECT document_id, 't:planx' || o_custkey AS series FROM {drawings}""")
def doc_series_key(t, spark):
    return t("drawings").select("document_id", text.series_key(F.col("name"), F.lit(None).cast("string")).alias("series"))


@query("S-21", "SELECT document_id, regexp_extract(name, '_([0-9]+)', 1) AS token FROM {drawings}")
def drawing_date_token(t, spark):
    return t("drawings").select("document_id", text.date_token(F.col("name")).alias("token"))


@query("S-07", """WITH m AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'SD-' WHEN 1 THEN 'aw' WHEN 2 THEN ' C ' WHEN 3 THEN 'X' ELSE 'W' END || s_suppkey % 40 AS raw FROM supplier), u AS (SELECT s_suppkey, upper(regexp_replace(raw, '\\s+', '', 'g')) AS t FROM m),
h AS (SELECT s_suppkey, regexp_extract(t, '^(SSD|ASD|SD|WD|FD|AD|ALD|GD|PD|HD|D|SSW|AW|PW|SW|ALW|WW|FW|W|SC|TC|C)-?([0-9]{{1,3}}[A-Z]?)$', ['h', 'n']) AS g FROM u)
SELECT s_suppkey, nullif(g.h || g.n, '') AS mark, CASE WHEN g.h = '' THEN NULL WHEN g.h LIKE '%D' THEN 'Door' WHEN g.h LIKE '%W' THEN 'Window' ELSE 'Column' END AS kind FROM h""")
def mark_parse(t, spark):
    k = F.col("s_suppkey") % 5
    raw = F.concat(F.when(k == 0, "SD-").when(k == 1, "aw").when(k == 2, " C ").when(k == 3, "X").otherwise("W"), (F.col("s_suppkey") % 40).cast("string"))
    return t("supplier").select("s_suppkey", text.mark(raw).alias("m")).select("s_suppkey", "m.mark", "m.kind")


@query("S-26 SC-29", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'H-' || p_size * 10 || 'x' || p_size * 5 || 'x6.5' WHEN p_partkey % 3 = 1 THEN 'PL-' || least(p_size, 20) || 'x' || greatest(p_size, 20) ELSE 'ODD' || p_size END AS section FROM part""")
def canonical_section(t, spark):
    n = F.col("p_size")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("h "), (n * 10).cast("string"), F.lit("*"), (n * 5).cast("string"), F.lit("×6.50"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("PL"), n.cast("string"), F.lit("x20"))).otherwise(F.concat(F.lit("odd"), n.cast("string")))
    return t("part").select("p_partkey", text.section(raw).alias("section"))


@query("S-25 S-17", "SELECT c_custkey, lower(replace(c_mktsegment, ' ', '')) AS room, lower('x-' || c_mktsegment) AS slug FROM customer")
def canonical_room_slug(t, spark):
    raw = F.concat(F.lit(" ."), F.substring("c_mktsegment", 1, 2), F.lit(" "), F.expr("substring(c_mktsegment, 3)"), F.lit("- "))
    return t("customer").select("c_custkey", text.room(raw).alias("room"), text.slug(F.concat(F.lit("##x _"), F.col("c_mktsegment"), F.lit(" "))).alias("slug"))


@query("S-12 S-13 S-14 T-14", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'B' || s_suppkey % 9 WHEN 1 THEN (1 + s_suppkey % 30) || 'F' WHEN 2 THEN 'RF' ELSE NULL END AS storey FROM supplier""")
def storey_inference(t, spark):
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey")
    raw = F.when(k == 0, F.concat(F.lit("지하"), (n % 9).cast("string"), F.lit("층 평면도"))).when(k == 1, F.concat(F.lit("plan "), (1 + n % 30).cast("string"), F.lit("FL"))).when(k == 2, F.lit("옥상 평면")).otherwise(F.concat(F.lit("1~"), (2 + n % 5).cast("string"), F.lit("층 평면도")))
    return t("supplier").select("s_suppkey", text.storey_from(raw).alias("storey"))


@query("S-09 S-05", """SELECT p_partkey, 'H-' || p_size || 'x20;' || CASE WHEN p_size = 30 THEN 'SHS' ELSE 'RHS' END || '-' || p_size || 'x30x6' AS sections FROM part""")
def steel_sections(t, spark):
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("beam H-"), n, F.lit("x20, post □ "), n, F.lit("*30 T6; PIPE"))
    found = F.transform(text.steel_sections(raw), lambda s: s["designation"])
    return t("part").select("p_partkey", F.array_join(found, ";").alias("sections"))


@query("S-11 S-10", """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'section' WHEN p_type IN ('SMALL', 'PROMO') THEN 'detail' WHEN p_type = 'LARGE' THEN 'plan' ELSE 'other' END AS code FROM part""")
def drawing_category(t, spark):
    title = F.when(F.col("p_type") == "ECONOMY", "X-SECTION A").when(F.col("p_type").isin("SMALL", "PROMO"), "door detail").when(F.col("p_type") == "LARGE", "3F PLAN").otherwise("sheet")
    return t("part").select("p_partkey", text.drawing_category(F.lit("cadsheet"), title)["code"].alias("code"))


@query("S-23 S-24 X-33", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ARCH' WHEN 1 THEN 'STRUCT' WHEN 2 THEN 'FIRE' ELSE NULL END AS discipline FROM part")
def discipline_ladder(t, spark):
    k = F.col("p_partkey") % 4
    number = F.when(k == 0, "AX-101").when(k == 1, "ST-20")
    place = F.when(k == 2, F.lit("drawings/소방/f.dwg")).otherwise(F.lit("drawings/x.dwg"))
    return t("part").select("p_partkey", text.discipline(number, place).alias("discipline"))


@query("S-06 P-16", "SELECT id, CASE WHEN confidence > 0.95 THEN 'AUTO_ACCEPT' WHEN confidence >= 0.75 THEN 'ACCEPT_WITH_WARNING' ELSE 'REQUIRE_VALIDATION' END AS state FROM {objects}")
def review_states(t, spark):
    return t("objects").select("id", text.review_state(F.col("confidence")).alias("state"))


@query("S-01 S-02 S-03 S-04 P-11", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Door' WHEN 1 THEN 'Wall' WHEN 2 THEN 'Stair' WHEN 3 THEN 'Annotation' WHEN 4 THEN 'Window' ELSE 'CADEntity' END AS label,
 CASE p_partkey % 6 WHEN 0 THEN 0.92 WHEN 1 THEN 0.91 WHEN 2 THEN 0.87 WHEN 3 THEN 0.78 WHEN 4 THEN 0.88 ELSE 0.35 END::DOUBLE AS confidence FROM part""")
def rule_classify(t, spark):
    k = F.col("p_partkey") % 6
    kind = F.when(k.isin(0, 4), "INSERT").when(k == 3, "TEXT").otherwise("LINE")
    layer = F.when(k == 1, "A-WALL").when(k == 2, "S_STRS").when(k == 3, "A-DOOR").otherwise("0")
    block = F.when(k == 0, "DOOR_900").when(k == 4, "AW")
    own = t("part").select("p_partkey", kind.alias("entity_type"), layer.alias("layer"), block.alias("block"), F.lit(None).cast("string").alias("attributes"))
    return rules.classified(own, distinct=True).select("p_partkey", "label", "confidence")


@query("S-28 S-60")
def stable_object_ids(t, spark):
    """Version-5 UUIDs; rows only, checked against Python in the tests."""
    return t("supplier").select("s_suppkey", identity.object_id(F.lit("P1"), F.lit("dxf"), F.col("s_name"), F.lit("Steel Section")).alias("object_id"))


@query("S-33 S-59 S-56 S-58", """SELECT c_custkey, regexp_matches(c_name, '[A-Za-z].*[A-Za-z].*[A-Za-z]') AS english, c_custkey % 400 AS denominator, CAST(c_custkey % 7 AS INTEGER) AS major FROM customer""")
def small_parsers(t, spark):
    n = F.col("c_custkey")
    return t("customer").select("c_custkey", text.is_english(F.col("c_name")).alias("english"), text.scale_denominator(F.concat(F.lit("A1 scale 1 / "), (n % 400).cast("string"))).cast("long").alias("denominator"), text.version_parts(F.concat(F.lit("v"), (n % 7).cast("string"), F.lit(".2-rc1")))[0].alias("major"))


@query("SC-09 A-37", """WITH g AS (SELECT unnest(regexp_extract_all(html, '<(?:[A-Za-z][\\w.-]*:)?([A-Za-z][\\w.-]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n FROM g GROUP BY 1""")
def html_tag_counts(t, spark):
    return t("pages").select(F.explode(files.tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("S-30 S-19 S-63 F-17", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS first_part FROM pages")
def url_fields(t, spark):
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("first_part"))


@query("X-35 T-15", "SELECT s_suppkey, least(s_suppkey, 50)::DOUBLE AS min_x, greatest(s_suppkey, 50)::DOUBLE AS max_x FROM supplier")
def bbox_parse(t, spark):
    box = text.bbox_of(F.concat_ws(",", F.lit("50"), F.lit("1"), F.col("s_suppkey").cast("string"), F.lit("9")))
    return t("supplier").select("s_suppkey", box.alias("b")).select("s_suppkey", "b.min_x", "b.max_x")


@query("S-38 D-06", """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')) AS t FROM benchmark), w AS (SELECT item_id, len(t) AS n, unnest(t) AS tok FROM b),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'))) AS tok FROM documents)
SELECT item_id, doc_id, round(count(*)::DOUBLE / max(n), 6) AS share FROM w JOIN d USING (tok) GROUP BY 1, 2 HAVING count(*)::DOUBLE / max(n) >= 0.8""")
def benchmark_contamination(t, spark):
    """Benchmark items most of whose words a document holds.

    A document with a share of 0.8 of an item's words cannot lack all of any n - ceil(0.8 n) + 1 of them: the rarest ones
    are the item's keys, documents that hold a key are candidates, and their shares are counted on the benchmark's words.
    """
    items = t("benchmark").select("item_id", text.token_set(F.col("text")).alias("own")).where("size(own) > 0")
    words = items.select(F.explode("own").alias("tok")).distinct()
    held = tables.shared(t("documents").select("doc_id", F.explode(text.token_set(F.col("text"))).alias("tok")).join(tables.broadcast_if_small(words, 100_000), "tok", "left_semi"), "held")
    often = held.groupBy("tok").agg(F.count("*").alias("df"))
    each = items.select("item_id", F.size("own").alias("n"), F.explode("own").alias("tok")).join(often, "tok", "left")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "tok"))
    keys = each.withColumn("nth", nth).where("nth <= n - ceil(0.8 * n - 1e-9) + 1").select("item_id", "tok")
    met = held.join(keys, "tok").select("doc_id", "item_id").distinct()
    both = met.join(held.groupBy("doc_id").agg(F.collect_list("tok").alias("words")), "doc_id").join(tables.broadcast_if_small(items, 10_000), "item_id")
    share = F.size(F.array_intersect("own", "words")) / F.size("own")
    return both.select("item_id", "doc_id", F.round(share, 6).alias("share"), share.alias("exact")).where("exact >= 0.8").drop("exact")


@query("S-43", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')) AS token FROM documents) SELECT token, count(*) AS df FROM w GROUP BY 1 HAVING count(*) BETWEEN 20 AND 40")
def rare_terms(t, spark):
    return search.rare_terms(t("documents"), "doc_id", "text", 40).where("df >= 20")


@query("G-32", "SELECT conv_id, string_agg('[c' || turn || '] ' || role, chr(10) ORDER BY -1.0 / (turn + 1), 'c' || turn) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY -1.0 / (turn + 1), 'c' || turn) AS nth FROM conversations) WHERE nth <= 5 GROUP BY 1")
def extractive_answer(t, spark):
    own = t("conversations").select(F.col("conv_id").alias("question_id"), (1.0 / (F.col("turn") + 1)).alias("score"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("cid"), F.col("role").alias("text"))
    return knowledge.extract_answer(own).select(F.col("question_id").alias("conv_id"), "answer")
