"""Operator 8: BPE encoding and decoding.

Encoding: an Aho-Corasick automaton finds the longest token at each place of a pre-token; the encoder walks left to
right and takes a token only if it is compatible with the one before it (their merge trees leave the border between
them alone), going back to the next shorter token where it is not. The result equals that of the ordered merges.
Decoding: a table of all tokens' bytes with offsets gives a token's form by its id; the library joins them by a space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from draftlake.llm.common import batches, id_and_text, ragged
from draftlake.llm.word_bpe import Vocabulary, WordTable, encoded, vocabulary, word_symbols


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.compatible: dict[tuple[int, int], bool] = {}
        self.length = {i: len(s) for i, s in vocab.form.items()}
        made = {s: i for i, s in vocab.form.items()}
        whole = {i for i in vocab.form if self.merged(vocab.form[i]) == [i]}
        self.tokens = ahocorasick.Automaton()
        for i in whole:
            self.tokens.add_word(vocab.form[i], (i, self.length[i]))
        self.tokens.make_automaton()
        self.shorter = {}
        for i in whole:
            s = vocab.form[i]
            self.shorter[i] = next((made[s[:n]] for n in range(len(s) - 1, 0, -1) if made.get(s[:n]) in whole), None)

    def merged(self, symbols: str) -> list[int]:
        """The ordered merges, one at a time: used for the vocabulary's own tokens when the tables are built."""
        ids = [self.v.base[c] for c in symbols]
        while len(ids) > 1:
            best = min(((self.v.rank[m], k) for k in range(len(ids) - 1) if (m := self.v.pair.get((ids[k], ids[k + 1]))) is not None), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.v.pair[ids[k], ids[k + 1]]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay apart: no merge over their border comes before those that build them."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is not None:
            return known
        v = self.v
        rank, limit, ok = v.rank, None, True
        left, right = a, b
        while True:
            joined = v.pair.get((left, right))
            if joined is not None and (limit is None or (rank[joined], 0) < limit):
                ok = False
                break
            ra, rb = rank.get(left, -1), rank.get(right, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, left = (ra, 0), v.split[left][1]
            else:
                limit, right = (rb, 1), v.split[right][0]
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def word(self, symbols: str) -> list[int]:
        n = len(symbols)
        best, size = [None] * n, [0] * n
        for end, (i, length) in self.tokens.iter(symbols):
            start = end - length + 1
            if length > size[start]:
                best[start], size[start] = i, length
        open_at = [True] * (n + 1)
        out: list[int] = []
        at, token, length_of, shorter = 0, best[0], self.length, self.shorter
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + length_of[token]
                if open_at[end] and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = end
                    token = best[end] if end < n else None
                    break
                token = shorter[token]
                if token is None:
                    open_at[at] = False
                    token = out.pop()
                    at -= length_of[token]
                    break
        return out

    def words(self, words: list[str]) -> list[list[int]]:
        return [self.word(word_symbols(w)) for w in words]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


class Forms:
    """All tokens' bytes in one block with offsets, and the same for their ids as decimals; each ends with a space."""

    def __init__(self, vocab: Vocabulary):
        n = max(vocab.text) + 1
        self.shown = self.block([vocab.text.get(i, "").encode() + b" " for i in range(n)])
        self.decimal = self.block([b"%d " % i for i in range(n)])

    @staticmethod
    def block(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(f) for f in forms], np.int64)
        return np.frombuffer(b"".join(forms), np.uint8), np.cumsum(length) - length, length

    @staticmethod
    def joined(block: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, cuts: np.ndarray) -> Iterator[bytes]:
        """For each row of ids its forms, without the last space."""
        data, begin, length = block
        own = length[ids]
        at = np.concatenate([[0], np.cumsum(own)])[cuts].tolist()
        raw = memoryview(data[ragged(begin[ids], own)])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield raw[a : max(a, b - 1)]


@lru_cache(2)
def forms_table(path: str) -> tuple[WordTable, Forms]:
    """Ids of pre-tokens by the encoder, and the tokens' forms; kept for all tasks of a worker."""
    own = encoder(path)
    return WordTable(own.words), Forms(own.v)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: its number of tokens and the digests of its ids and of the text decoded from them.

    A null text counts as empty: no tokens, the digests of nothing. A row with a null doc_id keeps it; repeated rows
    give repeated results; an empty table gives none. Special strings in a text become special ids, as the library
    does by default. A text of any length is encoded whole; ties cannot arise. Columns other than doc_id and text are
    not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, forms), specials = forms_table(vocabulary_path), vocabulary(vocabulary_path).specials

        def one(batch: pa.RecordBatch) -> dict:
            ids, cuts = encoded(words, batch.column("text"), specials)
            digests = ([hashlib.sha256(x).hexdigest() for x in forms.joined(block, ids, cuts)] for block in (forms.decimal, forms.shown))
            return {"doc_id": batch.column("doc_id"), "n_tokens": np.diff(cuts), **dict(zip(("ids_sha256", "decoded_sha256"), digests, strict=True))}

        yield from batches(rows, one, schema)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
