"""Operator 5: language identification by prediction by partial matching.

Every language has a tree of byte contexts up to order 3. A byte's code length is that of its count in the longest
context seen in training; an unseen byte pays the context's escape (method C: distinct bytes over total plus distinct)
and is tried in the next shorter one, down to a uniform order -1. Training counts stay frozen, so a byte's code length
depends only on its last four bytes and is computed once for each; a text's is the exact sum. The shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import U64, Entries, batches, chunks, release, share_of, small_batches, utf8

ORDER = 3
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with its three predecessors in the same text as one number; before a text stand zeros."""
    b = FOLD[data].astype(np.uint32)
    place = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = b.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(b), np.uint32)
        before[k:] = b[:-k] if k < len(b) else before[k:]
        before[place < k] = 0
        out |= before << np.uint32(8 * k)
    return out


class Tree:
    """Frozen counts of one language: for each order, symbols in contexts and the contexts' totals and distinct symbols."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER, -1, -1):
            keys, back = np.unique(gram & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(back, n, minlength=len(keys))
            contexts, at = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(at, count), np.bincount(at).astype(float)
            self.levels.append((keys, count, contexts, total, distinct))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each number's last byte after the bytes before it."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for order, (keys, count, contexts, total, distinct) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            if not len(left) or not len(keys):
                continue
            own = gram[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            context = own >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            met = contexts[at] == context
            where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[where] == own
            mass = total[at] + distinct[at]
            out[left[hit]] -= np.log2(count[where[hit]] / mass[hit])
            escape = met & ~hit
            out[left[escape]] -= np.log2(distinct[at[escape]] / mass[escape])
            left = left[~hit]
        out[left] += 8.0
        return out


@dataclass
class Model:
    languages: list[str]
    gram: list[np.ndarray]
    count: list[np.ndarray]
    _state: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"languages": self.languages, "gram": self.gram, "count": self.count, "_state": {}}

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        if not self._state:
            self._state["trees"] = [Tree(g, n) for g, n in zip(self.gram, self.count, strict=True)]
            self._state["entries"] = Entries(bits=19, most=600_000)
            self._state["values"] = np.zeros((1 << 16, len(self.languages)))
        entries, trees = self._state["entries"], self._state["trees"]
        if entries.full():
            entries.clear()
        gram = grams(data, offsets)
        with np.errstate(over="ignore"):
            keys = gram.astype(U64) * U64(0x9E3779B97F4A7C15)

        def make(where):
            own = np.column_stack([t.bits(gram[where]) for t in trees])
            need = entries.size + len(own)
            while len(self._state["values"]) < need:
                self._state["values"] = np.concatenate([self._state["values"], np.zeros_like(self._state["values"])])
            self._state["values"][entries.size : need] = own

        found = entries.find(keys, make)
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.languages)):
                out[some, k] = np.add.reduceat(self._state["values"][:, k][found], offsets[:-1][some])
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, most: int = 1500, most_bytes: int = 24 << 20) -> Model:
    """Count byte contexts in about `most` documents and `most_bytes` bytes of each language at most, by a hash of doc_id.

    Both bounds hold on average; they bound the counts that reach the driver, at most one for each byte. Only rows with a text, a lang and a doc_id outside the held-out quarter teach.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    totals = own.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    sizes = {r["lang"]: min(1.0, most / r["n"], most_bytes / max(1, r["size"])) for r in totals.collect()}  # a row a language
    if not sizes:
        return Model([], [], [])
    share = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    chosen = own.where(share_of(F.col("doc_id")) <= share[F.col("lang")])
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> dict:
            data, offsets = utf8(batch.column("text"))
            lang = batch.column("lang").to_pylist()
            names = sorted(set(lang))
            code = np.array([names.index(x) for x in lang], np.int64)
            key, n = np.unique(np.repeat(code, np.diff(offsets)) << 32 | grams(data, offsets), return_counts=True)
            return {"lang": pa.array(names, pa.string()).take(pa.array(key >> 32)), "gram": key & 0xFFFFFFFF, "n": n}

        yield from batches(rows, one, schema)

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    lang = np.array(got.column("lang").to_pylist(), object)
    gram, n = got.column("gram").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    names = sorted(set(lang.tolist()))
    return Model(names, [gram[lang == x] for x in names], [n[lang == x] for x in names])


def has_letters(array: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    known = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = known[offsets[1:]] > known[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = any(map(str.isalpha, array[k].as_py()))
    return out


def predictions(model: Model, array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of the posterior under equal priors, and code length per byte of each text."""
    langs, scores, rates = [], [], []
    _, all_offsets = utf8(array)
    for a, b in chunks(all_offsets):
        part = array.slice(a, b - a)
        data, offsets = utf8(part)
        sure = has_letters(part, data, offsets) & bool(model.languages)
        n = np.maximum(np.diff(offsets), 1)
        if model.languages:
            bits = model.bits(data, offsets)
            best = bits.argmin(1)
            score = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            langs += [model.languages[k] if s else "und" for k, s in zip(best.tolist(), sure.tolist(), strict=True)]
            scores.append(np.where(sure, score, 0.0))
            rates.append(np.where(sure, bits.min(1) / n, 0.0))
        else:
            langs += ["und"] * len(n)
            scores.append(np.zeros(len(n)))
            rates.append(np.zeros(len(n)))
    return langs, np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0), *rates])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), bits_per_byte of the shortest code.

    A text that is null or has no letters is `und` with score 0, and so is every text where nothing was learned. A null
    doc_id is kept and not held out; repeated rows give repeated results; an empty table gives none. Equal code lengths
    go to the language first in alphabetical order. Texts of any length are coded whole. With `keep`, those columns are returned too in a struct `kept`, and text beside it.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")]
    own = small_batches(docs).select(*columns, *([F.struct(*keep).alias("kept")] if keep else []))
    more = [f"kept {own.schema['kept'].dataType.simpleString()}", "text string"] if keep else []

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            langs, scores, rates = predictions(model, batch.column("text"))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rates)]
            names = ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]
            if keep:
                out, names = [*out, batch.column("kept"), batch.column("text")], [*names, "kept", "text"]
            yield pa.RecordBatch.from_arrays(out, names=names)
        release()

    return own.mapInArrow(run, ", ".join([SCHEMA, *more]))


