"""Lexical, vector and hybrid search; full-text ranking; portable memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import similarity, text
from draftlake.operators.tables import broadcast_if_small

#: Kinds that restate what a typed object says; fixed values.
GENERIC_KINDS = ("Annotation", "Layer", "BlockDefinition", "Dimension", "CADEntity", "View", "Page", "Document")


def postings(rows: DataFrame, key: str, body: str) -> DataFrame:
    """token, key, tf, length: the inverted index of a text column."""
    own = rows.select(key, text.token_list(F.col(body)).alias("tokens"))
    return own.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("token", key, "length").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, key: str, body: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score for rows that hold a term; only postings of the query's terms are shuffled."""
    own = rows.select(key, text.token_list(F.col(body)).alias("tokens")).select(key, F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits"))
    whole = own.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    tf = own.select(key, "length", F.explode("hits").alias("token")).groupBy(key, "length", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # a row a term
    both = tf.join(F.broadcast(df), "token").join(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return both.groupBy(key).agg(F.sum(part).alias("score"))


def knn(vectors: DataFrame, query: list[float], key: str, column: str, k: int, least: float | None = None) -> DataFrame:
    """The k rows of largest cosine to one vector."""
    own = vectors.select(key, similarity.cosine(F.col(column), F.array(*map(F.lit, query))).alias("similarity"))
    own = own if least is None else own.where(F.col("similarity") > least)
    return own.orderBy(F.desc("similarity"), key).limit(k)


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query_id, rank, id, similarity for a stated set of queries (query_id, q), in blocks against all vectors (id, v).

    Each block is a matrix that goes to the tasks; a task keeps its k best of each query for every Arrow batch.
    """
    n = queries.count()
    parts = max(1, -(-n // block))
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = None
    for part in range(parts):
        own = numbered.where(F.col("part") == part).select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids = own.column("query_id").to_numpy()
        matrix = own.column("q").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        one = vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(nearest_of(ids, matrix, k), "query_id long, id long, similarity double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_of(ids: np.ndarray, matrix: np.ndarray, k: int, rows: int = 2048) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, v) the pairs that can be among a query's k best: all ties at the border stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = batch.column("id").to_numpy(zero_copy_only=False)
                for a in range(0, len(ids), 256):
                    rough = matrix[a : a + 256] @ v.T
                    rough[ids[a : a + 256, None] == own[None, :]] = -np.inf
                    some = min(k, rough.shape[1])
                    least = -np.partition(-rough, some - 1, axis=1)[:, some - 1]
                    row, col = np.nonzero((rough >= least[:, None] - 1e-9 * np.abs(least[:, None])) & (rough > -np.inf))
                    exact = (matrix[a : a + 256][row] * v[col]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256][row]), pa.array(own[col]), pa.array(exact)], names=["query_id", "id", "similarity"])

    return run


def hybrid(objects: DataFrame, terms: list[str], vector: list[float] | None, k: int) -> DataFrame:
    """Objects (id, label, kind, body, v) by 0.6 lexical + 0.4 vector + kind bonus, among lexical and vector candidates."""
    lexical = similarity.contained_score(F.col("body"), terms)
    near = F.lit(None).cast("double") if vector is None else similarity.cosine(F.col("v"), F.array(*map(F.lit, vector)))
    own = objects.select("id", "label", "kind", lexical.alias("lexical"), near.alias("vector"))
    own = own.where((F.col("lexical") > 0) | (F.col("vector") > 0.4))
    score = similarity.hybrid_score(F.col("lexical"), F.col("vector"), ~F.col("kind").isin(*GENERIC_KINDS))
    return own.withColumn("score", score).orderBy(F.desc("score"), "label", "id").limit(k)


def fuzzy(rows: DataFrame, body: str, query: str, least: float = 0.3) -> DataFrame:
    """Rows whose text resembles the query: a native bound first, the exact measure on what passes it."""
    own = rows.where(similarity.trigram_bound(F.lit(query), F.col(body)) > least)
    return own.withColumn("similarity", similarity.word_similarity(F.lit(query), F.col(body))).where(F.col("similarity") > least)


def memory(objects: DataFrame, project_of: str, question: str, k: int) -> DataFrame:
    """Objects (id, project, body) by overlap with a question's tokens; the project's name counts half."""
    query = text.token_set(F.lit(question))
    score = similarity.memory_score(query, text.token_set(F.col("body")), text.token_set(F.col(project_of)))
    own = objects.select("id", F.col(project_of).alias("project"), score.alias("score")).where("score > 0")
    return own.orderBy(F.desc("score"), "project", "id").limit(k)


def similar_projects(features: DataFrame, k: int) -> DataFrame:
    """The k pairs of projects (project, feature) of largest Jaccard coefficient, with their scores.

    Features that the same projects have count together: pairs are made of the distinct sets of projects, not of every
    feature, so that what all projects share is one row.
    """
    own = features.where(F.col("project").isNotNull() & F.col("feature").isNotNull()).distinct()
    size = own.groupBy("project").agg(F.count("*").alias("n"))
    sets = own.groupBy("feature").agg(F.array_sort(F.collect_list("project")).alias("projects")).groupBy("projects").agg(F.count("*").alias("common"))
    each = sets.where(F.size("projects") > 1).select("projects", "common", F.posexplode("projects").alias("at", "project"))
    pairs = each.select("project", "common", F.explode(F.slice("projects", F.col("at") + 2, F.size("projects"))).alias("other"))
    common = pairs.groupBy("project", "other").agg(F.sum("common").alias("common"))
    out = common.join(size, "project").join(size.select(F.col("project").alias("other"), F.col("n").alias("m")), "other")
    return out.select("project", "other", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("score")).orderBy(F.desc("score"), "project", "other").limit(k)


def rare_terms(rows: DataFrame, key: str, body: str, most: int) -> DataFrame:
    """Tokens that at most `most` rows hold, with their document frequency."""
    return rows.select(key, F.explode(text.token_set(F.col(body))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= most)


def gram_index(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, sequence: the trigrams of each row's text in order; the postings of a trigram index are its exploded sets."""
    return rows.select(key, similarity.gram_sequence(F.col(body)).alias("sequence"))


def fuzzy_join(queries: DataFrame, index: DataFrame, key: str, least: float) -> DataFrame:
    """query_id, key, similarity of every query (query_id, query) and row of an index (gram_index) whose similarity is at least `least` (above 0).

    A row that similar shares at least least * n of a query's n trigrams, so it has one of any n - least * n + 1 of
    them: candidates come from the postings of a query's rarest so many. Each is then measured exactly. Queries or rows
    without trigrams have no partners; query_id and key must be distinct.
    """
    wanted = queries.select("query_id", similarity.trigrams(F.col("query")).alias("wanted")).where(F.size("wanted") > 0)
    postings = index.select(key, F.explode(F.array_distinct("sequence")).alias("gram"))
    grams = wanted.select("query_id", F.size("wanted").alias("n"), F.explode("wanted").alias("gram"))
    found = postings.join(grams.select("gram").distinct(), "gram", "left_semi")
    frequency = found.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "gram")
    rarest = grams.join(frequency, "gram").withColumn("turn", F.row_number().over(order))
    # trigrams that no row holds come first in the order, so they have used up places of the prefix
    missing = grams.join(frequency, "gram", "left_anti").groupBy("query_id").agg(F.count("*").alias("missing"))
    needed = F.greatest(F.ceil(F.col("n") * least - 1e-9), F.lit(1))
    prefix = rarest.join(missing, "query_id", "left").where(F.col("turn") + F.coalesce("missing", F.lit(0)) <= F.col("n") - needed + 1)
    pairs = postings.join(prefix.select("query_id", "gram"), "gram").select("query_id", key).distinct()
    both = pairs.join(wanted, "query_id").join(index, key)
    shared = F.size(F.array_intersect("wanted", "sequence")) >= F.size("wanted") * least - 1e-9
    out = both.where(shared).select("query_id", key, similarity.extent_similarity(F.col("wanted"), F.col("sequence")).alias("similarity"))
    return out.where(F.col("similarity") >= least)


def question_terms(questions: DataFrame, most: int = 8) -> DataFrame:
    """question_id, place, term of every question (question_id, question): its first distinct terms of two characters or more."""
    terms = F.filter(F.array_distinct(text.relevance_terms(F.col("question"), 1 << 20)), lambda w: F.length(w) >= 2)
    return questions.select("question_id", F.posexplode(F.slice(terms, 1, most)).alias("place", "term"))


def pack_drawings(drawings: DataFrame, key: str, body: str, questions: DataFrame, common: int = 600, least: float = 0.6) -> DataFrame:
    """question_id, key, score: drawings by half the mean similarity of a question's terms and half that of the whole question.

    The whole is written apart or together, whichever is nearer. Candidates resemble (`least`) a term that no more than
    `common` drawings resemble; where a question has no such term, its whole. All questions are answered in one plan:
    terms and wholes are queries of one fuzzy join, whose frequencies choose the rare ones.
    """
    terms = question_terms(questions)
    place = F.struct("place", "term")
    whole = terms.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["term"]).alias("terms"))
    asked = whole.select("question_id", F.explode(F.array(F.struct(F.lit(-1).alias("place"), F.array_join("terms", " ").alias("term")), F.struct(F.lit(-2).alias("place"), F.array_join("terms", "").alias("term")))).alias("q")).select("question_id", "q.*")
    asked = terms.unionByName(asked).withColumn("query_id", place_of("question_id", "place"))
    index = gram_index(drawings, key, body)
    near = fuzzy_join(asked.select("query_id", F.col("term").alias("query")), index, key, least).join(asked.select("query_id", "question_id", "place"), "query_id")
    frequency = near.where("place >= 0").groupBy("question_id", "place").agg(F.count("*").alias("df")).where(F.col("df") <= common)
    rare = near.join(frequency.select("question_id", "place"), ["question_id", "place"], "left_semi")
    others = near.where("place = -1").join(frequency.select("question_id"), "question_id", "left_anti")
    candidates = rare.select("question_id", key).unionByName(others.select("question_id", key)).distinct()
    scored = candidates.join(asked.select("question_id", "place", similarity.trigrams(F.col("term")).alias("wanted")), "question_id").join(index, key)
    scored = scored.select("question_id", key, "place", similarity.extent_similarity(F.col("wanted"), F.col("sequence")).alias("s"))
    score = 0.5 * F.avg(F.when(F.col("place") >= 0, F.col("s"))) + 0.5 * F.max(F.when(F.col("place") < 0, F.col("s")))
    return scored.groupBy("question_id", key).agg(score.alias("score"))


def place_of(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])
