"""Operators 1, 7 and 8 against the tokenizer libraries, the packing against exhaustive search."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from draftlake.llm import common, encode_decode, packing, token_counts
from draftlake.llm.word_bpe import encoded, special_parts

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def fuzz(seed, n=1500):
    rng = random.Random(seed)
    alphabet = "aàbc'strevlmdD  .,!?12٣\n\t<|>éİΣßü漢字🙂́▁ \x1c\x85"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "a" * 3000, "ab" * 900, "'s 'T I'LL they'd''s", "<|endoftext|>a<|startoftext|>"]


def test_encoding_and_decoding_equal_the_library():
    texts = fuzz(1)
    library = Tokenizer.from_file(WORD)
    own = encode_decode.encoder(WORD)
    forms = encode_decode.Forms(own.v)
    table = encode_decode.WordTable(own.words)
    ids, cuts = encoded(table, pa.array(texts), own.v.specials)
    for k, (text, form, decimal) in enumerate(zip(texts, forms.joined(forms.shown, ids, cuts), forms.joined(forms.decimal, ids, cuts), strict=True)):
        mine = ids[cuts[k] : cuts[k + 1]].tolist()
        assert mine == library.encode(text, add_special_tokens=False).ids
        assert bytes(form).decode() == library.decode(mine, skip_special_tokens=False)
        assert bytes(decimal).decode() == " ".join(map(str, mine))


def test_every_code_point_equals_the_library():
    """Letters, marks and lower case newer than Python's tables too, alone and beside a mark."""
    library, own = Tokenizer.from_file(WORD), encode_decode.encoder(WORD)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}!" for c in points[k : k + (1 << 16)]]
        if points[k] < 0x20000:
            texts += [f"{chr(c)}\u0307x" for c in points[k : k + (1 << 16)]]
        table = encode_decode.WordTable(own.words)
        ids, cuts = encoded(table, pa.array(texts), own.v.specials)
        lists = np.split(ids, cuts[1:-1])
        for text, mine, want in zip(texts, lists, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert mine.tolist() == want.ids, [hex(ord(x)) for x in text]


def test_special_strings_take_linear_time():
    text = "<|endoftext|>a" * 100_000
    assert len(special_parts(text, {"<|endoftext|>": 1, "<|startoftext|>": 2})) == 200_001


def test_compatible_pairs_equal_ordered_merges():
    own = encode_decode.encoder(WORD)
    rng = random.Random(2)
    for _ in range(2000):
        symbols = "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 14)))
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        assert own.word(symbols) == own.merged(symbols)


def test_counts_equal_the_library():
    texts = fuzz(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.Counter(token_counts.pieces(PIECE)).rows(pa.array(texts))
    assert got.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def test_long_pre_tokens():
    rng = random.Random(8)
    texts = ["theinandering" * 300, "a" * 5000, "abab" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)), "=" * 4001, "漢字" * 900]
    texts += ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.Counter(token_counts.pieces(PIECE)).rows(pa.array(texts))
    assert got.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def thue_morse(a, b, n=2048):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_a_polynomial_confuses():
    """Thue-Morse words collide under any polynomial modulo 2**64: tables must compare what they find."""
    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    texts = [one, two, f"{two} {one}", one, two]
    library, counter = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    points = np.frombuffer((one + two).encode("utf-32-le"), np.uint32)
    at = np.array([0, 2048])
    hashes = common.span_hashes(points, at, at + 2048)
    assert hashes[0] == hashes[1]
    own = encode_decode.encoder(WORD)
    for encode in (own.words, packing.word_ids(WORD).encode):
        ids, cuts = encoded(encode_decode.WordTable(encode), pa.array(texts), own.v.specials)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(cuts.tolist())] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.Counter(token_counts.pieces(PIECE)).rows(pa.array(texts)).tolist() == [len(counter.encode(t)) for t in texts]
    data = np.frombuffer((one + two).encode(), np.uint8)
    strong = common.byte_hashes(data, at, at + 2048)
    assert strong[0] != strong[1]


def test_special_strings():
    assert special_parts("a<|x|>b<|x|>", {"<|x|>": 9}) == ["a", 9, "b", 9, ""]


def least_bins(sizes, capacity):
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i, b in enumerate(bins):
            if b + sizes[k] <= capacity and b not in bins[:i]:
                put(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))), reverse=True)
    counts = {n: sizes.count(n) for n in sizes}
    plan = packing.Planner(counts, 20).plan()
    used = {}
    for times, parts in plan:
        assert sum(n * k for n, k in parts) <= 20
        for n, k in parts:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    assert sum(t for t, _ in plan) == least_bins(sizes, 20)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("share", [20_000, 2])
def test_packing(spark, odd, share):
    rows = packing.pack(odd, WORD, capacity=64, share=share).collect()
    check_packing(rows, 64)
    library = Tokenizer.from_file(WORD)
    whole = {}
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            whole.setdefault((r.doc_id, k // 64, k, len(part), zlib.crc32(part.tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == whole


def test_empty_tables(none):
    assert packing.pack(none, WORD).count() == 0
    assert token_counts.count_tokens(none, PIECE).count() == 0
    assert encode_decode.encode_and_decode(none, WORD).count() == 0


def test_odd_rows(odd):
    counts = token_counts.count_tokens(odd, PIECE).collect()
    assert len(counts) == odd.count()
    by = {r.doc_id: r for r in counts}
    assert (by[3].n_tokens, by[4].n_tokens, by[4].n_bytes) == (0, 0, 0)
    assert by[9].over_limit and not by[1].over_limit
    codes = {r.doc_id: r for r in encode_decode.encode_and_decode(odd, WORD).collect()}
    assert codes[4].ids_sha256 == codes[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert codes[1] == codes[2].__class__(**{**codes[2].asDict(), "doc_id": 1}) or codes[1].ids_sha256 == codes[2].ids_sha256


@pytest.mark.parametrize("counts", [{1: 100_000}, {5: 50_000}, {1: 30_000, 5: 20_000, 700: 40, 3000: 7}])
def test_planner_fills_sequences_with_short_pieces(counts):
    plan = packing.Planner(counts, 4096).plan()
    used = {}
    for times, parts in plan:
        assert sum(n * k for n, k in parts) <= 4096
        for n, k in parts:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    tokens = sum(n * c for n, c in counts.items())
    assert sum(t for t, _ in plan) == (-(-counts[5] // 819) if list(counts) == [5] else -(-tokens // 4096))
