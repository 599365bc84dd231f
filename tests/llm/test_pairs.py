"""Operators 2, 9 and 10 and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

from draftlake.llm import line_dedup, nearest, ngram_join

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_sets(docs):
    out = []
    for i, t in docs:
        w = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute_components(docs):
    sets, parent = shingle_sets(docs), {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(a), root(i)) for i, a in sets}


def near_documents(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(50)]
    docs = []
    for i in range(n):
        r = rng.random()
        if docs and r < 0.55:
            t = (rng.choice(docs)[1] or "x").split(" ")
            for _ in range(rng.randrange(0, 2 + len(t) // 25)):
                k = rng.randrange(len(t))
                t[k] = rng.choice(words)
        elif r < 0.8:
            t = [rng.choice(words) for _ in range(rng.randrange(50))] + passage
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        docs.append((i, " ".join(t) if rng.random() > 0.02 else None))
    return docs


@pytest.mark.parametrize(("few", "held"), [(32, 200_000), (0, 200_000), (1, 40)])
def test_shingle_join(spark, monkeypatch, few, held):
    """Buckets tried in full, by prefixes, and cut into portions."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "HELD", held)
    monkeypatch.setattr(ngram_join, "SHARE", 3)
    docs = near_documents(few)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_shingle_join_parts_sets_of_one_digest(spark, monkeypatch):
    real = ngram_join.digests

    def weak(values, sizes, seed=0):
        out = real(values, sizes, seed)
        return out if seed else np.where(out > 0, (out & np.uint64(14)) | np.uint64(1), out)

    monkeypatch.setattr(ngram_join, "digests", weak)
    docs = near_documents(9, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_shingle_join_of_words_that_a_polynomial_confuses(spark):
    from tests.llm.test_tokens import thue_morse

    rows = [(3, thue_morse("a", "b")), (4, thue_morse("b", "a")), (5, thue_morse("a", "b"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: (1, 3), 4: (1, 4), 5: (1, 3)}


def test_hot_bucket_pairs_only_across_components(spark):
    """A bucket of many near-copies in one component and a stranger makes about one candidate a member."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(1500):
        t = list(base)
        t[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(t)))
    docs.append((5000, " ".join([*base[:300], *(f"y{i}" for i in range(100))])))
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 5000 else 5000 for i, _ in docs}


def test_shingle_join_of_odd_rows(odd, none):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[1].n_shingles == 10
    assert (by[3].n_shingles, by[4].n_shingles, by[5].n_shingles) == (0, 0, 0) and by[5].component_id == 5
    assert by[None].component_id is None and by[None].n_shingles == 8
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize("size", [4, 5, 9, 37, 120, 1000])
def test_index_loses_no_pair(size):
    """Any two sets at the bound share an entry unless both are marked for the prefix join."""
    rng = np.random.default_rng(size)
    for trial in range(40):
        pool = rng.integers(1, 1 << 63, 2 * size, dtype=np.uint64)
        most = 2 * size * 20 // 180
        drop = min(size - 1, most // 2)
        a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[: size - drop], pool[size : size + most - drop]]))
        union = len(np.union1d(a, b))
        if 100 * (len(a) + len(b) - union) < 80 * union or (len(a) == len(b) and (a == b).all()):
            continue
        entries, short = ngram_join.index(np.concatenate([a, b]), np.array([len(a), len(b)]), np.array([1, 2], np.uint64))
        one, two = (set(entries["sig"][entries["node"] == k].tolist()) for k in (1, 2))
        assert one & two or short.all()


def brute_lines(docs, most):
    seqs = {i: [(k, x.strip(" \t\x0b\x0c\r"), len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in docs}
    first, gone = {}, {i: set() for i in seqs}
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(x[2] for x in s[a : b + 1]) >= most:
                    first.setdefault(tuple(x[1] for x in s[a : b + 1]), (i, a))
    for i, s in seqs.items():
        for a in range(len(s)):
            for b in range(a, len(s)):
                if sum(x[2] for x in s[a : b + 1]) >= most and first[tuple(x[1] for x in s[a : b + 1])] < (i, a):
                    gone[i] |= {s[k][0] for k in range(a, b + 1)}
    return gone


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = ["a b c", "d e", "f", "g h i j k l", "m n", "", "  ", "o p q r", "s t u v w x y z aa bb cc"]
    docs = []
    for i in range(80):
        t = [rng.choice(lines) for _ in range(rng.randrange(12))]
        if docs and rng.random() < 0.5:
            o = (rng.choice(docs)[1] or "").split("\n")
            a = rng.randrange(len(o))
            t[len(t) // 2 : len(t) // 2] = o[a : a + rng.randrange(1, 9)]
        docs.append((i * 3, "\n".join(t) if rng.random() > 0.05 else None))
    gone = brute_lines(docs, 10)
    rows = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = dict(docs)[r.doc_id]
        want = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[r.doc_id]) if text else text
        assert (r.text, r.n_deleted) == (want, len(gone[r.doc_id]))


def test_line_dedup_of_odd_rows(spark, odd, none):
    out = line_dedup.dedup(odd, 10)
    assert out.columns == [*odd.columns, "n_lines", "n_deleted"]
    by = {(r.doc_id, r.n_deleted): r for r in out.collect()}
    assert by[1, 0].text and by[2, 1].text == "" and by[4, 0].text is None and by[3, 0].text == ""
    assert line_dedup.dedup(none).count() == 0
    same = spark.createDataFrame([(1, "p q r s"), (1, "p q r s"), (1, "x\np q r s")], "doc_id long, text string")
    kept = sorted(r.text for r in line_dedup.dedup(same, 3).collect())
    assert kept in (["p q r s", "p q r s", "x"], ["", "", "x\np q r s"])


def test_line_dedup_of_lines_that_a_polynomial_confuses(spark):
    from tests.llm.test_tokens import thue_morse

    words = " ".join(["w"] * 60)
    docs = [(1, f"{thue_morse('a', 'b')}\n{words} 1"), (2, f"{thue_morse('b', 'a')}\n{words} 2"), (3, f"x\n\n{thue_morse('a', 'b')}\n \n  {words} 1\nend")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: (docs[1][1], 0), 3: ("x\n\n \nend", 2)}


def test_line_dedup_compares_lines(spark, monkeypatch):
    """With one hash for all windows nothing that differs goes."""
    monkeypatch.setattr(line_dedup, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    docs = [(i, f"line {i} a b c\nline {i} d e f") for i in range(6)]
    assert sum(r.n_deleted for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()) == 0


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 5 == 0:
            out[q] = sorted(((-float((v * w).sum()), i) for i, w in good if i != q))[:k]
    return out


@pytest.mark.parametrize(("scale", "wide"), [(False, 10**9), (True, 10**9), (False, 0)])
def test_nearest(spark, monkeypatch, scale, wide):
    monkeypatch.setattr(nearest, "WIDE", wide)
    monkeypatch.setattr(nearest, "SHARE", 7)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = rng.normal(size=8)
        v = v / np.linalg.norm(v) * (rng.uniform(0.5, 2) if scale else 1)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[10][1]) for i in range(40)]  # one very common vector
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] + [1.0] * 7), (2004, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank string, score double")
    want = brute_nearest(rows, 6)
    from pyspark.sql import functions as F

    got = {}
    for r in nearest.search(df, F.col("vec_id") % 5 == 0, k=6, recall=0.97).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert got.keys() == want.keys()
    hits = 0
    for q, near in got.items():
        assert [x[0] for x in sorted(near)] == list(range(1, 7))
        own = [(x[1], x[2]) for x in sorted(near)]
        assert own == sorted(own)
        hits += len({x[1] for x in own} & {x[1] for x in want[q]})
    assert hits / (6 * len(want)) >= 0.9
    common = [x[2] for x in sorted(got[10])]
    assert scale or common == sorted(common)[:6] and common[0] == 1000


def test_nearest_of_few_rows(spark):
    from pyspark.sql import functions as F

    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(rows, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest.search(rows.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.test_text_models import corpus

    docs, labels = corpus(spark, 150)
    extra = docs.where("doc_id < 40").withColumn("doc_id", docs.doc_id + 1000)
    docs.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(kept & good) > 0.9 * len(good) and len(kept - good) < 5
    assert not {i for i in kept if i >= 1000 and i - 1000 in kept}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name


def test_shingle_join_with_a_copy_without_id_first(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = spark.createDataFrame([(None, text), (1, text), (2, near)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.join(rows).collect()}
    assert got == {None: 1, 1: 1, 2: 1}


@pytest.mark.parametrize("n", range(1, 8))
def test_shingles_of_few_words(n):
    text = " ".join("abcdefg"[:n]).encode()
    values, sizes = ngram_join.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert sizes.tolist() == [max(1, n - 4)] and len(values) == sizes[0]


def test_shingle_join_of_a_document_of_three_words(spark):
    rows = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(rows).collect()] == [(1, 1, 1)]


def test_best_keeps_ties_to_the_smaller_id():
    rng = np.random.default_rng(2)
    vectors = np.unique(rng.integers(0, 2, (900, 12)), axis=0).astype(float)
    ids = rng.permutation(len(vectors))
    queries = vectors[:70]
    got = [np.concatenate(x) for x in zip(*nearest.best(queries, vectors, ids, 5, block=32), strict=True)]
    scores = queries @ vectors.T
    for k in range(len(queries)):
        want = sorted(zip((-scores[k]).tolist(), ids.tolist(), strict=True))[:5]
        assert list(zip((-got[2][got[0] == k]).tolist(), got[1][got[0] == k].tolist(), strict=True)) == want


def test_nearest_of_one_hot_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(int(i), [float(j == k) for j in range(64)]) for k, i in enumerate(np.random.default_rng(4).permutation(64))]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 16 == 0, k=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    near = {q: [i for _, i in sorted(x)] for q, x in got.items()}
    want = {q: [i for i in range(64) if i != q][:6] for q in range(0, 64, 16)}
    assert near.keys() == want.keys() and all(len(x) == 6 and x == sorted(x) and q not in x for q, x in near.items())
    assert sum(len(set(near[q]) & set(want[q])) for q in want) >= 0.9 * 24


@pytest.mark.parametrize("wide", [10**9, 0])
def test_nearest_recall_comes_from_the_buckets(spark, monkeypatch, wide):
    """Clustered vectors, far more than the buckets looked into hold; nothing but the tables gives results."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(nearest, "WIDE", wide)
    rng = np.random.default_rng(6)
    n, k = 12_000, 20
    centres = rng.normal(size=(60, 32))
    v = (centres[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 32))).astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(rows, F.col("vec_id") % 100 == 0, k=k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, n, 100)) and all(len(x) == k for x in got.values())
    near = v[::100] @ v.T
    hits = 0
    for q, x in got.items():
        own = near[q // 100].copy()
        own[q] = -9
        hits += len(x & set(np.argpartition(-own, k)[:k].tolist()))
    assert hits / (k * len(got)) >= 0.9


def test_probes_of_two_rotations_are_the_best():
    hasher = nearest.Hasher(8, 1.0, False, 2, tables=1)
    v = np.random.default_rng(1).normal(size=(20, 8))
    (near, _), every = hasher.table_order(v, 0, 37), hasher.affinity(v, 0)
    for k in range(20):
        assert np.allclose(np.sort(every[k, near[k]]), np.sort(every[k])[-37:])
    hasher = nearest.Hasher(8, 1.0, False, 2, tables=3)
    table, bucket = hasher.nearest(v, 50)
    every = np.stack([hasher.affinity(v, t) for t in range(3)], 1)
    for k in range(20):
        assert np.allclose(np.sort(every[k, table[k], bucket[k]]), np.sort(every[k].ravel())[-50:])


def test_pipeline_against_brute_force(spark, tmp_path):
    """The learned decisions as the models give them; the rest by brute force over all rows."""
    import corpus_pipeline
    from draftlake.llm import language, quality
    from tests.llm.test_text_models import corpus

    docs, labels = corpus(spark, 120)
    rng = random.Random(4)
    rows = [tuple(r) for r in docs.collect()]
    line = " ".join(rng.choice(["the", "and", "with", "from", "were"]) for _ in range(60)).capitalize() + "."
    for k in range(12):  # a passage that several documents share, near copies, repeats
        i, text, lang, source, _ = rows[rng.randrange(120)]
        rows.append((300 + k, f"{text}\n{line}\nThe end of number {k} and of all that", lang, source, 1))
        rows.append((400 + k, text + " and then", lang, source, 1))
    rows += [rows[5], (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n ", "de", "s", 1), (903, "12 !", None, None, None)]
    docs = spark.createDataFrame(rows, docs.schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = {(r.doc_id, r.text) for r in quality.score(docs, quality.train(docs, labels), keep=["doc_id"]).where("predicted = 1").collect()}
    left = [r for r in rows if (r[0], r[1]) in good]
    frame = spark.createDataFrame(left, docs.schema)
    known = {(r.doc_id, r.text) for r in language.identify(frame, language.train(frame), keep=["doc_id"]).where("lang_pred != 'und' and score >= 0.5").collect()}
    left = sorted({(r[0], r[1]) for r in left if (r[0], r[1]) in known})
    gone = brute_lines(left, 50)
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in left]
    cut = [(i, t) for i, t in cut if not gone[i] or t.strip()]
    group = brute_components(cut)
    want = {i for i, _ in cut if group[i][1] == i}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want and len(want) > 60
    assert sum(r.piece == 0 for r in got) == len(want)
    texts = dict(cut)
    from draftlake.llm import packing

    alone = packing.pack(spark.createDataFrame([(i, texts[i]) for i in want], "doc_id long, text string"), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(got) == pieces(alone)


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        path = tmp_path / name
        docs.write.parquet(str(path / "documents.parquet"))
        labels.write.parquet(str(path / "labels.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(path))
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= docs.count()
        rows = corpus_pipeline.run(spark, str(path)).collect()
        assert name == "odd" or rows == []


def test_share_of_vectors_met_falls():
    """On clustered vectors a query meets a small share, and a smaller one where there are more vectors, at the same recall."""
    shares = []
    for n in (2_000, 20_000, 100_000):
        rng = np.random.default_rng(7)
        centres = rng.normal(size=(n // 50, 64))
        v = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, 64))
        v /= np.linalg.norm(v, axis=1)[:, None]
        hasher = nearest.Hasher(64, 1.0, False, 1)
        codes, few = hasher.codes(v), v[:24]
        close = np.argsort(-(few @ v.T), axis=1)[:, 1:21]
        need = np.sort(nearest.turns(hasher, few, np.repeat(np.arange(24), 20), codes[close.ravel()]))
        shares.append(nearest.share_met(hasher, codes, few, int(need[int(np.ceil(0.93 * len(need))) - 1])))
    assert shares[2] < 0.1 and shares[2] <= shares[1] + 0.01 <= shares[0] + 0.02
