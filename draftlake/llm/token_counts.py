"""Operator 7: token counts by rank-synchronous merging of ragged arrays.

The texts of a batch are cut where no piece of the vocabulary spans the border, so that no merge can cross a cut. The
distinct pre-tokens that are not yet known stand in one ragged array of symbols. In each round every pre-token merges
its lowest-rank pair, wherever that stands in it without overlap, from the left up to the first merge that makes a pair
of no higher rank: the order of single merges. Those without a pair leave. What survives is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from draftlake.llm.common import Entries, batches, id_and_text, ragged, utf8

NONE = np.int64(1) << np.int64(62)
SPACE_MARK = 0x2581


class Pieces:
    """The vocabulary of a .model file with byte fallback: symbols of single characters and the pairs that merge."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only a vocabulary with the identity normaliser and a prefix space is supported")
        scored = {p.piece: p.score for p in proto.pieces if p.type == 1}
        order = {p: r for r, p in enumerate(sorted(scored, key=lambda p: -scored[p]))}
        ranks = np.array([-scored[p] for p in order])
        dense = np.unique(ranks, return_inverse=True)[1]  # equal scores are ties
        self.ids = dict(order)
        for p in scored:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        pairs = {}
        for p, r in order.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (int(dense[r]), r)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        points = np.array(sorted(ord(c) for c in self.ids if len(c) == 1), np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[points] = [self.ids[chr(c)] for c in points.tolist()]
        single = np.array([c in scored for c in map(chr, points.tolist())])
        self.weight = np.ones(0x110000, np.int8)  # tokens of a character that stays alone
        at = np.arange(0x110000)
        self.weight[:] = 1 + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000)
        self.weight[points[single]] = 1
        self.beside = np.zeros(1 << 20, bool)  # pairs of characters inside some piece; a false hit only joins more
        for p in scored:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[self.border(np.array([ord(a)], np.uint32), np.array([ord(b)], np.uint32))] = True

    @staticmethod
    def border(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(12)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NONE where they do not merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def counts(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Surviving symbols of each pre-token points[start:end]."""
        out = np.zeros(len(starts), np.int64)
        size = ends - starts
        flat = points[ragged(starts, size)]
        run = Ragged(self.symbol[flat].astype(np.int64), self.weight[flat].astype(np.int64), np.repeat(np.arange(len(size)), size))
        run.ranked(self, np.arange(len(flat)))
        while run.n:
            low = np.minimum.reduceat(run.rank, run.begin)
            on = low < NONE
            if not on.all():
                out[run.owner[run.begin[~on]]] = np.add.reduceat(run.weight, run.begin)[~on]
                run.keep(np.repeat(on, run.size) & (run.weight > 0))
                continue
            hit = np.flatnonzero(run.rank == np.repeat(low, run.size))
            self.merge(run, hit)
        return out

    def merge(self, run: Ragged, hit: np.ndarray) -> None:
        """Merge the pairs at these places, each sequence's of its lowest rank, as one after the other would."""
        at = np.arange(len(hit))
        overlap = np.zeros(len(hit), bool)  # begins with the symbol that ends the pair before it
        overlap[1:] = run.next[hit[:-1]] == hit[1:]
        hit = hit[(at - np.maximum.accumulate(np.where(overlap, 0, at))) % 2 == 0]
        made, rank, right, left = run.made[hit], run.rank[hit], run.next[hit], run.last[hit]
        after = run.next[right]
        before = np.where(left >= 0, run.symbol[left], -1)
        beside = np.flatnonzero(right[:-1] == left[1:]) + 1
        before[beside] = made[beside - 1]
        behind = np.where(after >= 0, run.symbol[after], -1)
        # a merge that makes a pair of no higher rank is the last of this round in its sequence
        stop = (self.look(before, made)[0] <= rank) | (self.look(made, behind)[0] <= rank)
        earlier = np.cumsum(stop) - stop
        first = np.searchsorted(run.owner[hit], run.owner[hit], "left")
        go = earlier == earlier[first]
        hit, made, right, after = hit[go], made[go], right[go], after[go]
        run.symbol[hit], run.weight[hit], run.weight[right], run.rank[right] = made, 1, 0, NONE
        run.next[hit] = after
        run.last[after[after >= 0]] = hit[after >= 0]
        left = run.last[hit]
        run.ranked(self, np.concatenate([hit, left[left >= 0]]))
        run.dead += len(hit)
        if 2 * run.dead > run.n:
            run.keep(run.weight > 0)


class Ragged:
    """Sequences of symbols in one array, each symbol linked to its neighbours, with the rank of the pair it begins."""

    def __init__(self, symbol: np.ndarray, weight: np.ndarray, owner: np.ndarray):
        n = len(symbol)
        self.symbol, self.weight, self.owner = symbol, weight, owner
        self.rank, self.made = np.full(n, NONE), np.zeros(n, np.int64)
        self.link()

    def link(self) -> None:
        self.n = n = len(self.symbol)
        self.dead = 0
        edge = np.ones(n + 1, bool)
        edge[1:-1] = self.owner[1:] != self.owner[:-1]
        self.begin = np.flatnonzero(edge)[:-1]
        self.size = np.diff(np.append(self.begin, n))
        self.next = np.where(edge[1:], -1, np.arange(1, n + 1))
        self.last = np.where(edge[:-1], -1, np.arange(-1, n - 1))

    def keep(self, stay: np.ndarray) -> None:
        self.symbol, self.weight, self.owner, self.rank, self.made = (x[stay] for x in (self.symbol, self.weight, self.owner, self.rank, self.made))
        self.link()

    def ranked(self, pieces: Pieces, at: np.ndarray) -> None:
        after = self.next[at]
        self.rank[at], self.made[at] = pieces.look(self.symbol[at], np.where(after >= 0, self.symbol[after], -1))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Counter:
    def __init__(self, vocab: Pieces):
        self.v, self.entries, self.values = vocab, Entries(most=2_000_000), np.zeros(0, np.int64)

    def rows(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text of the column."""
        if self.entries.full():
            self.entries.clear()
            self.values = self.values[:0]
        rows = array.fill_null("").to_pylist()
        points = np.frombuffer(("".join([" " + r for r in rows])).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        begins = np.cumsum(lengths) - lengths
        points[points == 32] = SPACE_MARK
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = ~self.v.beside[self.v.border(points[:-1], points[1:])]
        edge[begins] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]

        def make(where):
            self.values = np.append(self.values, self.v.counts(points, starts[where], ends[where]))

        entry = self.entries.spans(points, starts, ends, make)
        found = self.values[entry]
        total = np.concatenate([[0], np.cumsum(found)])
        at = np.searchsorted(starts, np.append(begins, len(points)))
        out = total[at[1:]] - total[at[:-1]]
        out[lengths == 1] = 0  # no prefix is added to an empty text
        return out


@lru_cache(2)
def counter_of(path: str) -> Counter:
    return Counter(pieces(path))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: bytes of its text in UTF-8, its tokens, and whether these exceed the limit.

    A null text counts as empty: 0 bytes, 0 tokens. A row with a null doc_id keeps it; repeated rows give repeated
    results; an empty table gives none. A text of any length is counted whole; equal ranks merge from the left. Columns
    other than doc_id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary_path)

        def one(batch: pa.RecordBatch) -> dict:
            _, offsets = utf8(batch.column("text"))
            n = counter.rows(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "n_tokens": n, "over_limit": n > limit}

        yield from batches(rows, one, schema)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
