"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from draftlake.llm import variants
from draftlake.llm.registry import op12_spelling_variants, oracle_sql

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def brute_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words):
    near_of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in near_of.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near_of[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = "abeéÀz" if seed else "etaoinshr"
    words = {}
    while len(words) < 300:
        base = rng.choice(list(words)) if words and rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9)))
        k, op = rng.randrange(len(base)), rng.randrange(3)
        w = base[:k] + (rng.choice(alphabet) if op < 2 else "") + base[k + (op > 0) :]
        if len(w) >= 5:
            words[w] = rng.choice([3, 3, 6, 7, 20, 40, 90, 200])
    rows = variants.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(r) for r in rows} == brute_groups(words) and len(rows) == len(words)


def test_long_chains(spark):
    words = {"chain" + "x" * k: 3 * 2**k for k in range(40)}
    rows = variants.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {"chain" + "x" * 39}


def test_words_and_odd_rows(spark, odd, none):
    rng = random.Random(4)
    made = ["Straße", "ÉCOLE", "ÉcOLE", "l'école", "letters", "Letter", "lettre", "aaaaa", "naïve", "x" * 40, "Œuvre", "a×b÷c"]
    docs = [(k % 40 or None, " ".join(rng.choice(made) for _ in range(60))) for k in range(200)] + [(r.doc_id, r.text) for r in odd.collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = variants.words_of(df)
    assert {r.word: r.n for r in words.collect()} == brute_words(docs)
    assert {tuple(r) for r in variants.group(words).collect()} == brute_groups(brute_words(docs))
    assert {r.word: r.n for r in variants.words_of(odd).collect()} == brute_words([(r.doc_id, r.text) for r in odd.collect()])
    assert variants.group(variants.words_of(none)).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op12_spelling_variants(spark, sf).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(oracle_sql()["op12_spelling_variants"]).fetchall(), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: r[3] for r in got} == brute_words(docs)


def test_joins_are_not_broadcast(spark):
    """A vocabulary whose file is small unfolds to twelve entries a word, which must not pass through the driver."""
    words = spark.createDataFrame([(f"word{k}", 3 + k % 9) for k in range(50)], "word string, n long")
    for df in (variants.near_pairs(words), variants.group(words)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
