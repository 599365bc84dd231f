"""Operator 11 against a brute-force version of the method and against exact Jaccard coefficients."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from draftlake.llm import fingerprints as fp

M64 = (1 << 64) - 1


def long_hash(value, seed):
    return xxhash.xxh64((value & M64).to_bytes(8, "little"), seed=seed & M64).intdigest()


def shingles(text):
    w = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in re.split(r"[\x20\x09-\x0D]+", text.lower().strip(fp.SPACE)) if x]
    spans = [w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    out = set()
    for s in spans:
        h = 42
        for x in s:
            h = long_hash(x, h)
        out.add(h & (M64 >> 1))
    return out


def packed(text, bins, bits):
    low = 63 - (bins - 1).bit_length()
    least = {}
    for h in shingles(text):
        b, v = h >> low, h & ((1 << low) - 1)
        least[b] = min(v, least.get(b, v))
    if not least:
        return []
    values = []
    for i, (a, s, _) in enumerate(zip(*fp.orders(bins), strict=True)):
        at = i if i in least else next(p for t in range(bins) if (p := (a + t * s) % bins) in least)
        values.append(least[at] >> bits * (i % (low // bits)) & ((1 << bits) - 1))
    return values


def fields(longs, bits):
    return [(x & M64) >> (64 - bits - k) & ((1 << bits) - 1) for x in longs for k in range(0, 64, bits)]


@pytest.mark.parametrize(("bins", "bits", "few"), [(512, 4, 16), (64, 8, 16), (128, 2, 1), (64, 4, 65)])
def test_fingerprints_equal_brute_force(spark, monkeypatch, bins, bits, few):
    """Looking at other bins and searching the filled ones give the same."""
    monkeypatch.setattr(fp, "FEW", few)
    rng = random.Random(bins)
    words = [f"{a}{b}" for a in "aBçdé" for b in range(40)]
    texts = [" \n".join(rng.choice(words) for _ in range(n)) + " " * (n % 3) for n in [*range(12), 20, 40, 80, 160, 320, 900]]
    rows = fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bins=bins, bits=bits).collect()
    for r in rows:
        assert fields(r.fingerprint, bits) == packed(texts[r.doc_id], bins, bits)


def next_of(docs):
    known = sorted((r for r in docs if r[0] is not None), key=lambda r: (r[0], (r[1] or "").encode()))
    follow = [(a, b[1] or "") for a, b in zip(known, known[1:] + known[:1], strict=True)]
    return follow + [(r, known[0][1] or "" if known else "") for r in docs if r[0] is None]


def edited_of(text, other):
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_next_documents(spark, monkeypatch, parts):
    rng = random.Random(parts)
    docs = [(rng.choice([None, *range(30)]) if k % 3 else 1000 + k * k, rng.choice([None, "", "é🙂" * 5, f"text {k} of some words " * (k % 4)])) for k in range(120)]
    df = fp.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.next_text) for r in fp.with_next(df, parts).collect())
    assert got == sorted((a[0] is None, a[0] or 0, a[1] or "", b) for a, b in next_of(docs))


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = fp.edited(odd).collect()
    assert len(rows) == len(docs) and fp.edited(none).count() == 0
    want = sorted((a[0] is None, a[0] or 0, a[1] or "", edited_of(a[1] or "", b)) for a, b in next_of(docs))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.edited_text) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars == len(r.text) for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert {r.near_edited for r in rows if not r.text} == {1.0}
    lost = fp.edited(odd.where("doc_id is null")).collect()
    assert [r.edited_text for r in lost] == [r.text[: (r.n_chars + 1) // 2] for r in lost]
    one = fp.edited(odd.where("doc_id = 9")).first()
    assert one.near_next == 1.0 and one.edited_text == edited_of(one.text, one.text)


def test_likeness_is_the_jaccard_coefficient(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    docs = []
    for k in range(150):
        n = rng.choice([30, 120, 600, 2000])
        a = [rng.choice(words) for _ in range(n)]
        b = a[: int(n * rng.random())]
        docs.append((k, " ".join(a), " ".join(b + [rng.choice(words) for _ in range(n - len(b))])))
    df = spark.createDataFrame(docs, "id int, a string, b string")
    rows = df.select("id", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("near")).collect()
    off = []
    for r in rows:
        x, y = shingles(docs[r.id][1]), shingles(docs[r.id][2])
        off.append(r.near - len(x & y) / len(x | y))
    assert abs(sum(off) / len(off)) < 0.01  # no bias
    assert (sum(d * d for d in off) / len(off)) ** 0.5 < 0.04 and max(map(abs, off)) < 0.15


def test_likeness_of_short_texts(spark):
    """A text of few shingles fills few bins, but what the others borrow does not agree by one chance."""
    docs = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}", f"a{k} b{k} c{k} d{k} e{k} g{k}") for k in range(300)]
    near = [r[0] for r in spark.createDataFrame(docs, "id int, a string, b string").select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert max(abs(x - 1 / 3) for x in near) < 0.2 and abs(sum(near) / len(near) - 1 / 3) < 0.01


def test_query_columns(spark):
    from draftlake.llm.registry import op11_document_fingerprints

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op11_document_fingerprints(spark, sf).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        assert rows[i].edited_sha256 == hashlib.sha256(edited_of(t, u).encode()).hexdigest()
        assert len(rows[i].fingerprint) == fp.BINS * fp.BITS // 4
