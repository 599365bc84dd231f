"""Operator 13 against the tokenizer libraries and a brute-force version of groups and links."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from draftlake.llm import alignment
from draftlake.llm.registry import op13_cross_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(docs, libraries):
    a, b = libraries
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    shown = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    rows, linked = [], []
    for i, text in docs:
        text = text or ""
        x = [(t, bytes(shown[c] for c in a.id_to_token(t))) for t in (a.encode(" " + text, add_special_tokens=False).ids if text else [])]
        y = [(t, bytes([int(p[3:-1], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode()) for t in (b.encode(text) if text else []) for p in [b.id_to_piece(t)]]
        want = (" " + text).encode()
        if b"".join(s for _, s in x) != want or b"".join(s for _, s in y) != want:
            x = y = []
        ends = []
        for side in (x, y):
            at, own = 0, []
            for _, s in side:
                at += len(s)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in cuts:
            groups.append([[t for (t, _), e in zip(side, own, strict=True) if last < e <= c] for side, own in zip((x, y), ends, strict=True)])
            last = c
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        linked.append(links)
        text_of = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append([i, len(x), len(y), len(groups), sum(links.values()), hashlib.sha256(text_of.encode()).hexdigest() if groups else ""])
    count = Counter(p for links in linked for p in links)
    most = {}
    for (p, _), n in count.items():
        most[p] = max(n, most.get(p, 0))
    return [(*r[:5], sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), r[5]) for r, links in zip(rows, linked, strict=True)]


def texts(seed, n):
    rng = random.Random(seed)
    words = "the of alignment tokenizers <s> </s> <|endoftext|> <unk> <0x41> ▁ naïve Straße 漢字 🙂 \n \t    don't I'LL 1234 99 aaaaaaaa ===== ́ \x00 ﻿ int main(){}".split(" ")
    letters = "abcdefgh "
    out = []
    for k in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(12))) if k % 3 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        out.append((k, t))
    return [*out, (None, "a text without an id"), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "=" * 3001 + "a" * 500), (1, "a repeated id"), (1, "a repeated id")]


@pytest.mark.parametrize(("docs", "entries", "listed", "held"), [(4096, 2_000_000, 4096, 1 << 20), (7, 50, 1, 300)])
def test_results_equal_brute_force(spark, monkeypatch, libraries, docs, entries, listed, held):
    """Blocks of all documents and of few; groups listed and by distinct ids; contributions held and handed on."""
    for name, value in (("DOCS", docs), ("ENTRIES", entries), ("LISTED", listed), ("HELD", held)):
        monkeypatch.setattr(alignment, name, value)
    own = texts(docs, 160)
    rows = alignment.align(spark.createDataFrame(own, "doc_id long, text string").repartition(3), A, B).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(brute(own, libraries), key=str)


def test_odd_rows(spark, odd, none, libraries):
    own = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 9]
    rows = alignment.align(odd.where("doc_id is null or doc_id != 9"), A, B).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(brute(own, libraries), key=str)
    long = alignment.align(odd.where("doc_id = 9"), A, B).first()
    a, b = libraries
    text = odd.where("doc_id = 9").first().text
    assert (long.n_a, long.n_b) == (len(a.encode(" " + text).ids), len(b.encode(text)))
    assert alignment.align(none, A, B).count() == 0


def test_entries_of_many_links(spark):
    """One pair linked more often than two bytes hold."""
    text = "x y" * 70_000
    row = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
    assert row.n_links == row.count_sum and row.n_links > 65535


def test_ids_equal_the_library_on_every_code_point(libraries):
    a, _ = libraries
    own = alignment.sides(A, B)[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 100_000):
        made = [f"a{chr(c)}b {chr(c)}1" for c in points[k : k + 100_000]]
        assert own.ids(made) == [x.ids for x in a.encode_batch_fast([" " + t for t in made], add_special_tokens=False)]


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_cross_tokenizer_alignment(spark, sf).collect())) == sorted(brute(docs, libraries))
