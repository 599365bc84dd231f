"""Operator 10: approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector, and the signed axis
nearest to the result is its bucket. Each of several tables rotates anew; where a table has more vectors than its axes
can part, two rotations together name the bucket. A query looks into its own bucket and then into those of the next
nearest axes, in one order over all tables, best first. How many it needs for the wanted recall is measured against brute force on a bounded sample of
queries. What the buckets hold is ranked by the exact inner product in double precision. The k-th best score in a bounded
reference sample is a floor below which no task has to report what it finds; the sample itself gives no results. A query
that finds fewer than k looks into all buckets.

Equal vectors are one class with its smallest ids; a large bucket is dealt over several keys, and the queries go to
all of them, so no bucket is too large for a task and none is cut. Vectors of unequal length get one more dimension
that makes the longest inner product the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import partitions, shared_table, small_batches

TABLES, WIDE = 6, 500_000
SHARE = 4000  # vectors of a bucket under one key
PAIRS = 20_000  # pairs of vectors that are multiplied at a time
REFERENCE, EIGHTH = 4000, 8  # vectors in the sample that gives floors: so many, and one in so many, at most
QUERIES = 1024  # queries of a bucket that a task holds at a time


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep its length."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Hasher:
    """Bucket codes of vectors and probe orders of queries in every table."""

    def __init__(self, dim: int, longest: float, lift: bool, depth: int, tables: int = TABLES, seed: int = 0):
        self.dim, self.longest, self.lift, self.depth, self.tables = dim, longest, lift, depth, tables
        self.width = 1 << max(1, (dim + lift - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, depth, 3, self.width))
        self.buckets = (2 * self.width) ** depth

    def points(self, v: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(v), self.width))
        norm = np.linalg.norm(v, axis=1)
        if self.lift and not query:
            out[:, : self.dim] = v / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        else:
            out[:, : self.dim] = v / norm[:, None]
        return out

    def axes(self, p: np.ndarray, table: int, k: int) -> np.ndarray:
        for s in self.signs[table, k]:
            p = hadamard(p * s)
        return np.hstack([p, -p])

    def codes(self, v: np.ndarray) -> np.ndarray:
        p, out = self.points(v, False), np.zeros((len(v), self.tables), np.int64)
        for t in range(self.tables):
            for k in range(self.depth):
                out[:, t] = out[:, t] * 2 * self.width + self.axes(p, t, k).argmax(1)
        return out

    def affinity(self, v: np.ndarray, table: int) -> np.ndarray:
        """How near each of a few queries is to every bucket of a table."""
        p = self.points(v, True)
        out = self.axes(p, table, 0)
        for k in range(1, self.depth):
            out = (out[:, :, None] + self.axes(p, table, k)[:, None, :]).reshape(len(v), -1)
        return out

    def table_order(self, v: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n buckets of a table nearest to each query, of one or two rotations, and how near they are."""
        p, n = self.points(v, True), min(n, self.buckets)
        one = self.axes(p, table, 0)
        if self.depth == 1:
            top = np.argpartition(-one, n - 1, axis=1)[:, :n]
            return top, np.take_along_axis(one, top, 1)
        two = self.axes(p, table, 1)
        first, second = (np.argsort(-x, axis=1) for x in (one, two))
        # the i-th and j-th axis together have at least (i + 1) (j + 1) - 1 pairs before them
        i = np.repeat(np.arange(2 * self.width), [min(2 * self.width, n // (k + 1)) for k in range(2 * self.width)])
        j = np.arange(len(i)) - np.searchsorted(i, i, "left")
        total = np.take_along_axis(one, first[:, i], 1) + np.take_along_axis(two, second[:, j], 1)
        top = np.argpartition(-total, n - 1, axis=1)[:, :n]
        return np.take_along_axis(first, i[top], 1) * 2 * self.width + np.take_along_axis(second, j[top], 1), np.take_along_axis(total, top, 1)

    def nearest(self, v: np.ndarray, n: int, tables: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tables and buckets of the n nearest to each query, in one order over all tables, or over the first few."""
        every = [self.table_order(v, t, n) for t in range(tables or self.tables)]
        bucket, near = (np.hstack(x) for x in zip(*every, strict=True))
        table = np.repeat(np.arange(len(every)), [b.shape[1] for b, _ in every])
        n = min(n, len(table))
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return table[top], np.take_along_axis(bucket, top, 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of queries: query rows, ids and exact scores of their k best; equal scores to the smaller id."""
    some, dim = min(len(ids), k), vectors.shape[1]
    longest = np.sqrt((vectors * vectors).sum(1).max())
    for a in range(0, len(queries), block):
        q = queries[a : a + block]
        rough = q @ vectors.T
        # either way of summing rounds by at most dim ulps of the lengths' product: none below this can be among the k best
        slack = 8 * dim * np.finfo(float).eps * np.sqrt((q * q).sum(1)) * longest + np.finfo(float).tiny
        least = -np.partition(-rough, some - 1, axis=1)[:, some - 1] - slack
        row, col = np.nonzero(~(rough < least[:, None]))  # so that what is not a number stays
        exact = np.concatenate([(q[row[at : at + PAIRS]] * vectors[col[at : at + PAIRS]]).sum(1) for at in range(0, len(row), PAIRS)])
        order = np.lexsort((ids[col], -exact, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row, "left") < k]
        yield row[order] + a, ids[col[order]], exact[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part, and two hashes that name equal ones."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return v.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.93, sample: int = 128, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is_query names, by largest inner product.

    is_query is a condition on vec_id. All other rows but the query's own are candidates; with fewer than k all of
    them are returned. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
    another dimension than the commonest (of equals the larger), nor rows with a null vec_id. Repeated rows of one
    vec_id with one vector count once. Ties go to the smaller vec_id, of however many. Vectors may have any length. An
    empty table gives no rows. Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    dim = dims[0]["d"]
    rows = rows.where(F.size("v") == dim)
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    # at most k + 1 ids of a class leave each task
    firsts = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    classes = firsts.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = shared_table(classes, "classes")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    targets = shared_table(classes.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("id", "v"), "targets")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest, shortest = classes.agg(F.count("*"), F.max(norm), F.min(norm)).first()
    few = targets.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not few.num_rows:
        return empty
    hasher = Hasher(dim, longest, longest > shortest * 1.001, 1 if n <= WIDE else 2, tables)
    probed = probes(classes, hasher, few, k, recall)
    some = classes.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(min(REFERENCE, n // EIGHTH)).select("id", "v").toArrow().combine_chunks()
    some_ids, some_v = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks(), dim)
    sizes = np.zeros((tables, hasher.buckets), np.int64)
    for r in counted(classes, hasher).collect():  # a row for each bucket: a constant number
        sizes[r["t"], r["bucket"]] = r["n"]
    salts = np.maximum(1, -(-sizes // SHARE))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, codes = part.column("id").to_numpy(), hasher.codes(matrix(part.column("v"), dim))
                for t in range(tables):
                    key = ((ids * 0x9E3779B1 >> 16) % salts[t, codes[:, t]] * tables + t) * hasher.buckets + codes[:, t]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(ids), bool)), part.column("id"), pa.array(np.full(len(ids), -np.inf)), part.column("v")], names=["key", "query", "id", "floor", "v"])

    def asking(probed: int, among: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    v, ids = matrix(part.column("v"), dim), part.column("id").to_numpy()
                    floor = np.full(len(v), -np.inf)
                    if len(some_ids) > k:
                        floor = np.concatenate([x[2] for x in best(v, some_v, some_ids, k + 1)]).reshape(len(v), -1)[:, -1]
                    table, bucket = hasher.nearest(v, probed, among)
                    row, table, bucket = np.repeat(np.arange(len(v)), table.shape[1]), table.ravel(), bucket.ravel()
                    full = sizes[table, bucket] > 0
                    row, table, bucket = row[full], table[full], bucket[full]
                    copies = salts[table, bucket]
                    salt = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                    row, table, bucket = (np.repeat(x, copies) for x in (row, table, bucket))
                    key = (salt * tables + table) * hasher.buckets + bucket
                    for a in range(0, len(key), 4096):
                        own = pa.array(row[a : a + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 4096]), pa.array(np.ones(len(own), bool)), part.column("id").take(own), pa.array(floor[row[a : a + 4096]]), part.column("v").take(own)], names=["key", "query", "id", "floor", "v"])

        return run

    pair = np.dtype([("q", "<i8"), ("s", "<f8"), ("c", "<i8")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come one after the other, each with its vectors first and then its queries."""
        found: list[np.ndarray] = []
        vectors: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        current = None

        def merge():
            e = np.concatenate(found)
            e = e[np.lexsort((e["c"], -e["s"], e["q"]))]
            again = np.zeros(len(e), bool)
            again[1:] = (e["q"][1:] == e["q"][:-1]) & (e["c"][1:] == e["c"][:-1])
            e = e[~again]
            found[:] = [e[np.arange(len(e)) - np.searchsorted(e["q"], e["q"], "left") <= k]]

        def answer():
            if asked and vectors:
                ids, v = (np.concatenate(x) for x in zip(*vectors, strict=True))
                vectors[:] = [(ids, v)]
                who, floor, q = (np.concatenate(x) for x in zip(*asked, strict=True))
                for row, near, score in best(q, v, ids, k + 1):
                    high = score >= floor[row]
                    e = np.empty(int(high.sum()), pair)
                    e["q"], e["s"], e["c"] = who[row[high]], score[high], near[high]
                    found.append(e)
                if sum(map(len, found)) > 400_000:
                    merge()
            asked.clear()

        for batch in batches:
            key, query, ids, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "query", "id", "floor"))
            v = matrix(batch.column("v"), dim)
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (query[1:] != query[:-1]), [True]])) if len(key) else np.zeros(0, int)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if key[a] != current:
                    answer()
                    vectors.clear()
                    current = key[a]
                if not query[a]:
                    vectors.append((ids[a:b].copy(), v[a:b]))
                    continue
                for at in range(a, b, QUERIES):
                    to = min(b, at + QUERIES)
                    asked.append((ids[at:to].copy(), floor[at:to].copy(), v[at:to]))
                    if sum(len(x[0]) for x in asked) >= QUERIES:
                        answer()
        answer()
        if found:
            merge()
            e = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(e["q"].copy()), pa.array(e["c"].copy()), pa.array(e["s"].copy())], names=["target", "near", "score"])

    def find(queries: DataFrame, probed: int, among: int = tables) -> DataFrame:
        schema = "key long, query boolean, id long, floor double, v array<double>"
        dealt = small_batches(classes).select("id", "v").mapInArrow(stored, schema).union(queries.mapInArrow(asking(probed, among), schema))
        hits = dealt.repartition(partitions(dealt), "key").sortWithinPartitions("key", "query").mapInArrow(look, "target long, near long, score double").distinct()
        top = Window.partitionBy("target").orderBy(F.desc("score"), "near")
        return hits.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth")

    hits = shared_table(find(targets, probed), "hits")
    full = hits.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n)).select(F.col("target").alias("id"))
    lacking = shared_table(targets.join(full, "id", "left_anti"), "lacking")
    if probed < tables * hasher.buckets and not lacking.isEmpty():
        hits = hits.join(full.withColumnRenamed("id", "target"), "target", "left_semi").union(find(lacking, hasher.buckets, 1))  # all buckets of a table hold all vectors
    names = classes.select(F.col("id").alias("near"), "ids")
    wide = hits.join(names, "near").select("target", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("target").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1)
    lists = wide.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    own = asked.join(classes.select("h1", "h2", F.col("id").alias("target")), ["h1", "h2"]).join(lists, "target")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def share_met(hasher: Hasher, codes: np.ndarray, queries: np.ndarray, probed: int) -> float:
    """The mean share of vectors (by their codes) that a query meets in so many buckets."""
    met = 0
    for q in range(len(queries)):
        table, bucket = hasher.nearest(queries[q : q + 1], probed)
        wanted = [set(bucket[0][table[0] == t].tolist()) for t in range(hasher.tables)]
        met += np.logical_or.reduce([np.isin(codes[:, t], list(w)) for t, w in enumerate(wanted)]).mean()
    return met / len(queries)


def counted(classes: DataFrame, hasher: Hasher) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = hasher.codes(matrix(batch.column("v"), hasher.dim))
            for t in range(hasher.tables):
                bucket, n = np.unique(codes[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(bucket), pa.array(n)], names=["t", "bucket", "n"])

    return classes.select("v").mapInArrow(run, "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n"))


def probes(classes: DataFrame, hasher: Hasher, few: pa.Table, k: int, recall: float) -> int:
    """Buckets a query looks into, in one order over all tables, so that the sample's true neighbours are found at the wanted rate."""
    ids, v = few.column("id").to_numpy(), matrix(few.column("v").combine_chunks(), hasher.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column("id").to_numpy(), matrix(batch.column("v"), hasher.dim)
            place = {int(x): i for i, x in enumerate(own)}
            for row, near, score in best(v, vectors, own, k + 1):
                rows = vectors[[place[int(x)] for x in near]]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(near), pa.array(score), pa.ListArray.from_arrays(np.arange(0, rows.size + 1, hasher.dim, dtype=np.int32), rows.ravel())], names=["row", "near", "score", "v"])

    found = classes.select("id", "v").mapInArrow(run, "row long, near long, score double, v array<double>")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "near"))
    got = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth").toArrow()
    row, near = got.column("row").to_numpy(), got.column("near").to_numpy()
    other = near != ids[row]
    if not other.any():
        return 1
    codes = hasher.codes(matrix(got.column("v").combine_chunks(), hasher.dim))
    need = np.sort(turns(hasher, v, row, codes)[other])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))])


def turns(hasher: Hasher, queries: np.ndarray, row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How many buckets the query queries[row] looks into until it meets the vector of these codes."""
    out = np.full(len(row), hasher.tables * hasher.buckets)
    for q in range(len(queries)):
        affinity = np.concatenate([hasher.affinity(queries[q : q + 1], t)[0] for t in range(hasher.tables)])
        order = np.sort(affinity)
        own = np.flatnonzero(row == q)
        nearest = np.max([affinity[t * hasher.buckets + codes[own, t]] for t in range(hasher.tables)], axis=0)
        out[own] = len(order) - np.searchsorted(order, nearest, "left")
    return out
