"""Operator 13: alignment of two tokenizers by a cogroup of postings.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where tokens of both end cut
the tokens into groups; all pairs of an A and a B token of a group are links. The texts of a block are encoded in one go
and leave, for each A id, one posting: the B ids it is linked with, in how many documents of the block, and how often in
each document. Postings and the corpus-wide counts of their A id are shuffled by that id and stream through a task
sorted, so that nothing but one id's counts is held. Each gives its documents' contributions, which are summed by block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import chunks, equal_spans, id_and_text, partitions, ragged, release, shared_table, utf8
from draftlake.llm.encode_decode import Forms

#: Documents and distinct (document, pair) entries of a block, about.
DOCS, ENTRIES = 4096, 2_000_000
#: Pairs of a group that are listed one by one; larger groups go by their distinct ids.
LISTED = 4096
#: Documents whose contributions a task holds before it hands them on.
HELD = 1 << 20
#: The pre-token pattern of byte-level vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """A tokenizer as ids of texts, and the bytes of its tokens in one block with offsets."""

    def __init__(self, forms: list[bytes]):
        self.n = len(forms)
        self.data, self.begin, self.length = Forms.block(forms)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.begin[ids], self.length[ids])]


class Bytes(Side):
    """A byte-level BPE .json whose ids follow its merges; special strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec["pre_tokenizer"], spec["model"]
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or made != sorted(made):
            raise ValueError("only a byte-level vocabulary with ids in the order of its merges is supported")
        forms = {i: bytes(shown[c] for c in t) for t, i in vocab.items()}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in forms.items()}, special_tokens={})
        self.path, self.library = path, None
        super().__init__([forms.get(i, b"") for i in range(max(forms) + 1)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.one(" " + t) for t in texts]

    def one(self, text: str) -> list[int]:
        try:
            return self.coder.encode_ordinary(text)
        except (ValueError, RuntimeError, UnicodeError):  # a run of millions without a border; the other library takes it
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.encode_special_tokens = True
            return self.library.encode(text, add_special_tokens=False).ids


class Pieces(Side):
    """A .model of pieces, which adds the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        piece = self.coder.id_to_piece
        super().__init__([bytes([int(piece(i)[3:-1], 16)]) if self.coder.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.coder.vocab_size())])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@lru_cache(2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side, tuple, tuple]:
    """Both tokenizers, and the decimals of their ids: each id followed by the sign that may stand behind it."""
    a, b = Bytes(a_path), Pieces(b_path)
    decimals = [Forms.block([b"%d%s" % (i, sign) for i in range(side.n) for sign in signs]) for side, signs in ((a, (b",", b"|")), (b, (b",", b";")))]
    return a, b, *decimals


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one after the other, and how many each row has."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty(int(n.sum()), np.int64)
    at = 0
    for row, k in zip(rows, n.tolist(), strict=True):
        out[at : at + k] = row
        at += k
    return out, n


class Aligned:
    """Groups and links of some texts."""

    def __init__(self, a_path: str, b_path: str, column: pa.Array):
        a, b, a_form, b_form = sides(a_path, b_path)
        texts = column.fill_null("").to_pylist()
        some = [k for k, t in enumerate(texts) if t]
        own = [texts[k] for k in some]
        ids, n = zip(flat(a.ids(own)), flat(b.ids(own)), strict=True)
        raw, offsets = utf8(pa.array([" " + t for t in own], pa.string()))
        good = np.ones(len(own), bool)
        for side, i, k in zip((a, b), ids, n, strict=True):
            size = side.length[i]
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(k)])]
            good &= np.diff(ends) == np.diff(offsets)
            at = np.flatnonzero(good)
            good[at] = equal_spans(side.bytes_of(i), ends[at], raw, offsets[at], np.diff(offsets)[at])
        keep = [np.repeat(good, k) for k in n]
        self.a, self.b = (i[k] for i, k in zip(ids, keep, strict=True))
        rows = np.array(some, np.int64)[good]
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.n_a[rows], self.n_b[rows] = n[0][good], n[1][good]
        a_end, b_end = (np.cumsum(side.length[i]) for side, i in ((a, self.a), (b, self.b)))
        common = a_end[np.isin(a_end, b_end, assume_unique=True)]
        # tokens of no bytes do not exist, so ends ascend and every document ends with a group
        self.a_group, self.b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        self.g_a, self.g_b = (np.bincount(g, minlength=len(common)) for g in (self.a_group, self.b_group))
        self.doc = np.repeat(rows, self.n_a[rows])  # of every A token
        last = np.cumsum(self.g_a) - 1
        self.g_doc = self.doc[last] if len(last) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.g_doc, minlength=len(texts)).astype(np.int64)
        # whole numbers, not the doubles of bincount with weights
        total = np.concatenate([[0], np.cumsum(self.g_a * self.g_b)])
        edge = np.concatenate([[0], np.cumsum(self.n_groups)])
        self.n_links = total[edge[1:]] - total[edge[:-1]]
        self.digests = self.digest(a_form, b_form, last)

    def digest(self, a_form: tuple, b_form: tuple, last: np.ndarray) -> list[str]:
        """Per text the digest of its groups' ids; an empty string without tokens."""
        n = len(self.a) + len(self.b)
        a_at = np.arange(len(self.a)) + (np.cumsum(self.g_b) - self.g_b)[self.a_group]
        b_at = np.arange(len(self.b)) + np.cumsum(self.g_a)[self.b_group]
        a_last, b_last = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_last[last] = 1
        b_last[np.cumsum(self.g_b) - 1] = 1
        a_form_at, b_form_at = 2 * self.a + a_last, 2 * self.b + b_last
        data = np.concatenate([a_form[0], b_form[0]])
        begin, length = np.empty(n, np.int64), np.empty(n, np.int64)
        begin[a_at], length[a_at] = a_form[1][a_form_at], a_form[2][a_form_at]
        begin[b_at], length[b_at] = b_form[1][b_form_at] + len(a_form[0]), b_form[2][b_form_at]
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        at = np.concatenate([[0], np.cumsum(length)])[cuts].tolist()
        raw = memoryview(data[ragged(begin, length)])
        return [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(at[:-1], at[1:], strict=True)]

    def entries(self, bits: tuple[int, int], listed: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys (A id, B id, place of the document) in order, and how many links each stands for."""
        whole = self.g_a * self.g_b <= listed
        one = np.flatnonzero(whole[self.a_group])
        group = self.a_group[one]
        n = self.g_b[group]
        first = np.cumsum(self.g_b) - self.g_b
        b = self.b[ragged(first[group], n)]
        key = np.repeat((self.a[one] << (bits[0] + bits[1])) + self.doc[one], n) + (b << bits[1])
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys, counts = [key[edge]], [np.diff(np.append(edge, len(key)))]
        a_first = np.cumsum(self.g_a) - self.g_a
        for g in np.flatnonzero(~whole).tolist():
            x, p = np.unique(self.a[a_first[g] : a_first[g] + self.g_a[g]], return_counts=True)
            y, q = np.unique(self.b[first[g] : first[g] + self.g_b[g]], return_counts=True)
            keys.append(((x[:, None] << (bits[0] + bits[1])) + (y << bits[1])[None, :] + self.g_doc[g]).ravel())
            counts.append((p[:, None] * q[None, :]).ravel())
        return summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.add.reduceat(counts, edge)


#: A block's postings have an A id, its documents' rows none.
POSTINGS = "block long, a int, b array<int>, docs array<int>, entries array<int>, places binary, links binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
_ints, _longs = pa.list_(pa.int32()), pa.list_(pa.int64())
POSTINGS_ARROW = pa.schema([("block", pa.int64()), ("a", pa.int32()), ("b", _ints), ("docs", _ints), ("entries", _ints), ("places", pa.binary()), ("links", pa.binary()), ("doc_id", _longs), *[(k, _longs) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string()))])


def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Little-endian bytes of each stretch of values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Block:
    """Documents and entries that are gathered until there are enough of them."""

    def __init__(self, number: int, bits: tuple[int, int]):
        self.number, self.bits = number, bits
        self.keys, self.counts, self.docs, self.size, self.entries = [], [], [], 0, 0

    def add(self, ids: pa.Array, found: Aligned, listed: int = LISTED) -> None:
        keys, counts = found.entries(self.bits, listed)
        self.keys.append(keys + self.size)
        self.counts.append(counts)
        self.docs.append((ids.to_pylist(), found.n_a, found.n_b, found.n_groups, found.n_links, found.digests))
        self.size += len(ids)
        self.entries += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = [[x for d in self.docs for x in d[0]], *[np.concatenate([d[k] for d in self.docs]) for k in range(1, 5)], [x for d in self.docs for x in d[5]]]
        own = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name) if f.name != "block" else self.number], f.type) for f in POSTINGS_ARROW], schema=POSTINGS_ARROW)
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        low = self.bits[0] + self.bits[1]
        # an entry of more links than two bytes hold is several, which stand for one document
        many = (counts + 65534) // 65535
        first = np.cumsum(many) - many
        links = np.full(int(many.sum()), 65535, np.int64)
        links[first + many - 1] = counts - 65535 * (many - 1)
        pair, place = keys >> self.bits[1], keys & ((1 << self.bits[1]) - 1)
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        docs, entries = np.diff(np.append(at, len(pair))), np.diff(np.append(first, len(links))[np.append(at, len(pair))])
        a, b = keys[at] >> low, pair[at] & ((1 << self.bits[0]) - 1)
        cut = np.concatenate([np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64), [len(a)]])
        fine = np.concatenate([[0], np.cumsum(entries)])[cut]
        places, links = np.repeat(place, many).astype("<u2"), links.astype("<u2")
        step = 512
        for k in range(0, len(cut) - 1, step):
            c, f = cut[k : k + step + 1], fine[k : k + step + 1]
            p, q, n = slice(c[0], c[-1]), slice(f[0], f[-1]), len(c) - 1
            own = [pa.array(np.full(n, self.number)), pa.array(a[c[:-1]], pa.int32()), *[lists(x[p], c - c[0], pa.int32()) for x in (b, docs, entries)], *[blobs(x[q], f - f[0]) for x in (places, links)]]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(n, f.type) for f in POSTINGS_ARROW][len(own) :], schema=POSTINGS_ARROW)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Postings and documents of all blocks; a block's number names its task and its turn there."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, *_ = sides(a_path, b_path)
        bits = ((b.n - 1).bit_length(), (2 * DOCS - 1).bit_length())
        number = TaskContext.get().partitionId() << 32
        block = Block(number, bits)
        for batch in rows:
            _, offsets = utf8(batch.column("text"))
            for p, q in ((r, min(q, r + DOCS)) for p, q in chunks(offsets) for r in range(p, q, DOCS)):
                part = batch.slice(p, q - p)
                block.add(part.column("doc_id"), Aligned(a_path, b_path, part.column("text")), LISTED)
                if block.size >= DOCS or block.entries >= ENTRIES:
                    yield from block.rows()
                    number += 1
                    block = Block(number, bits)
        if block.size:
            yield from block.rows()
        release()

    return id_and_text(docs).mapInArrow(run, POSTINGS)


STREAM = "block long, places binary, best binary, sum binary"
STREAM_ARROW = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("best", pa.binary()), ("sum", pa.binary())])


def contributions(rows: Iterator[pa.RecordBatch], most_held: int = HELD) -> Iterator[pa.RecordBatch]:
    """From one A id's counts and then its postings, sorted so, each document's links of the highest count and sum of counts."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for block, sums in held.items():
            some = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, some.astype("<u4").tobytes(), sums[0][some].astype("<i8").tobytes(), sums[1][some].astype("<i8").tobytes()), STREAM_ARROW, strict=True)], schema=STREAM_ARROW)

    known, number, most = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in rows:
        column = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        for k in range(batch.num_rows):
            b, n = (np.asarray(column[c][k].values) for c in ("b", "n"))
            block = column["block"][k].as_py()
            if block is None:
                known, number, most = b, n, int(n.max())
                continue
            count = number[np.searchsorted(known, b)]
            each = np.asarray(column["entries"][k].values)
            place, links = (np.frombuffer(column[c][k].as_buffer(), "<u2") for c in ("places", "links"))
            count, links = np.repeat(count, each), links.astype(np.int64)
            sums = held.get(block)
            top = int(place.max()) + 1
            if sums is None or sums.shape[1] < top:
                grown = np.zeros((2, max(top, 256 if sums is None else 2 * sums.shape[1])), np.int64)
                if sums is not None:
                    grown[:, : sums.shape[1]] = sums
                size += grown.shape[1] - (0 if sums is None else sums.shape[1])
                held[block] = sums = grown
            np.add.at(sums[0], place, np.where(count == most, links, 0))
            np.add.at(sums[1], place, links * count)
            if size > most_held:
                yield from handed()
                held, size = {}, 0
    yield from handed()
    release()


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_ARROW = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def totals(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block with the sums of their contributions; a block's documents come before them."""
    docs = sums = None

    def done() -> Iterator[pa.RecordBatch]:
        if docs is not None:
            columns = docs | {"n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns[f.name], np.ndarray) else columns[f.name] for f in RESULT_ARROW], schema=RESULT_ARROW)

    for batch in rows:
        column = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        for k in range(batch.num_rows):
            if column["places"][k].is_valid:
                place = np.frombuffer(column["places"][k].as_buffer(), "<u4")
                for own, name in zip(sums, ("best", "sum"), strict=True):
                    own[place] += np.frombuffer(column[name][k].as_buffer(), "<i8")
            else:
                yield from done()
                docs = {c: column[c][k].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                sums = np.zeros((2, len(docs["n_a"])), np.int64)
    yield from done()


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A null or empty text, and one that the tokens do not spell exactly, has no tokens: zeros and an empty digest. A null
    doc_id is kept; repeated rows are documents of their own, which count; an empty table gives none. Texts of any
    length are encoded whole; of equal counts all are the highest. Columns other than doc_id and text are not read.

    An A id's counts stay within the size of the B vocabulary. The postings of a frequent A id are dealt to as many
    tasks as its share of all entries asks for, and its counts are sent to each of them.
    """
    spark, parts = docs.sparkSession, partitions(docs)
    both = shared_table(encoded(docs, a_path, b_path), "postings")
    postings = both.where(F.col("a").isNotNull())
    counts = postings.select("a", F.explode(F.arrays_zip("b", "docs")).alias("p")).groupBy("a", F.col("p.b").alias("b")).agg(F.sum("p.docs").alias("n"))
    size = postings.groupBy("a").agg(F.sum(F.octet_length("places")).alias("size"))
    # at most one row for each id of the vocabulary
    salted = size.crossJoin(F.broadcast(size.agg(F.sum("size").alias("all")))).select("a", F.ceil(F.col("size") * (4 * parts) / F.col("all")).cast("int").alias("salts"))
    salted = shared_table(salted, "salts")
    ids = F.array_sort(F.collect_list(F.struct("b", "n")))
    known = counts.groupBy("a").agg(ids.alias("p")).join(F.broadcast(salted), "a")
    known = known.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("block"), F.col("p.b").alias("b"), F.col("p.n").alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in (("entries", "array<int>"), ("places", "binary"), ("links", "binary"))])
    dealt = postings.join(F.broadcast(salted), "a").select("a", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int").alias("salt"), "block", "b", F.array().cast("array<long>").alias("n"), "entries", "places", "links")
    stream = known.unionByName(dealt).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("block").asc_nulls_first())
    most_held = HELD
    given = stream.mapInArrow(lambda rows: contributions(rows, most_held), STREAM)
    rows = both.where(F.col("a").isNull()).select("block", *[F.lit(None).cast("binary").alias(c) for c in ("places", "best", "sum")], "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    summed_up = rows.unionByName(given, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", F.col("places").isNotNull())
    return summed_up.mapInArrow(totals, RESULT)
