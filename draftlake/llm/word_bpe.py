"""Pre-tokens and merges of a lower-casing word BPE vocabulary (a tokenizers .json with word-end symbols).

A text becomes a row of pre-tokens by numpy: NFC, lower case, then runs of letters, single digits, runs of other
characters and the seven English contractions. Each distinct pre-token is encoded once and kept in a bounded table.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from draftlake.llm.common import KEPT, Entries, ragged, utf8

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


#: A code point for private use stands for what a pattern of the library has found.
FOUND = 0xE000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the library's own patterns see it: white space, letter, number or other."""
    from tokenizers import Regex, normalizers

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((NUMBER, r"\p{N}"), (LETTER, r"\p{L}"), (SPACE, r"\s")):
        mark = normalizers.Replace(Regex(pattern), chr(FOUND))
        for first in range(0, sys.maxunicode + 1, 1 << 15):
            points = np.arange(first, first + (1 << 15), dtype=np.uint32)
            points = points[(points < 0xD800) | (points > 0xDFFF)]
            if len(points):
                shown = np.frombuffer(mark.normalize_str(points.tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
                out[points[(shown == FOUND) & (points != FOUND)]] = kind
    return out


@lru_cache(1)
def uncertain() -> np.ndarray:
    """Code points whose order or case the library may see otherwise than Python: marks, and those that Python does not know."""
    kinds = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
    return np.fromiter((k == "Cn" or k[0] == "M" for k in kinds), bool, sys.maxunicode + 1)


@lru_cache(1)
def library_normaliser():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def lower(text: str) -> str:
    """Lower case without the rule for a final sigma."""
    return text.replace("Σ", "σ").lower()


def normalised(array: pa.Array) -> tuple[str, np.ndarray]:
    """All rows, NFC and lower case, each followed by a line end; and where each begins. What Python may see otherwise, the library does."""
    rows = array.fill_null("").to_pylist()
    joined = "\n".join(rows) + "\n"
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    if not joined.isascii():
        bad = np.flatnonzero(uncertain()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)])
        odd = set(np.unique(np.searchsorted(np.cumsum(lengths), bad, "right")).tolist())
        if not unicodedata.is_normalized("NFC", joined):
            odd.update(k for k, r in enumerate(rows) if not unicodedata.is_normalized("NFC", r))
        for k in odd:
            rows[k] = library_normaliser().normalize_str(rows[k])
            lengths[k] = len(rows[k]) + 1
        joined = "\n".join(rows) + "\n" if odd else joined
    low = lower(joined)
    if len(low) != len(joined):
        lengths = np.fromiter((len(lower(r)) for r in rows), np.int64, len(rows)) + 1
    return low, np.concatenate([[0], np.cumsum(lengths)])


def pre_tokens(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and the starts and ends of the pre-tokens."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1].copy(), cuts[1:].copy()
    first = kind[starts]
    quote = np.flatnonzero((points[starts] == 39) & (ends - starts == 1) & (first == OTHER))
    quote = quote[quote + 1 < len(starts)]
    quote = quote[first[quote + 1] == LETTER]
    if len(quote):
        one = points[ends[quote]]
        two = points[np.minimum(ends[quote] + 1, len(points) - 1)]
        long = ends[quote + 1] - starts[quote + 1] >= 2
        take = np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32)).astype(np.int64)
        take[long & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))] = 2
        ends[quote] += take
        starts[quote + 1] += take
    keep = (first != SPACE) & (starts < ends)
    return points, starts[keep], ends[keep]


class Vocabulary:
    """Merges, tokens and splits of a .json vocabulary; the symbols of a word are its bytes, the last one marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}

        def symbols(token: str) -> str:
            end = token.endswith(suffix) and len(token) > len(suffix)
            own = [shown[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, own[:-1])) + chr(own[-1] + 256 * end)

        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.form = {i: symbols(t) for t, i in vocab.items() if t not in self.specials}
        by_form = {s: i for i, s in self.form.items()}
        self.rank, self.pair, self.split = {}, {}, {}
        for r, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = by_form[symbols(a)], by_form[symbols(b)]
            made = by_form[self.form[a] + self.form[b]]
            self.pair[a, b] = made
            if made not in self.rank:
                self.rank[made], self.split[made] = r, (a, b)
        self.base = {s: i for s, i in by_form.items() if len(s) == 1}


@lru_cache(2)
def special_tokens(path: str) -> dict[str, int]:
    """The special strings and their ids, without the tables of the whole vocabulary."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_symbols(word: str) -> str:
    raw = word.encode("utf-8", "surrogatepass")
    return raw[:-1].decode("latin-1") + chr(raw[-1] + 256)


class WordTable:
    """Ids of distinct pre-tokens as one ragged array; `encode` gives the list of ids of each new word."""

    def __init__(self, encode):
        self.encode = encode
        self.entries = Entries(most=300_000)
        self.clear()
        KEPT.append(self)

    def clear(self) -> None:
        self.entries.clear()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def add(self, rows: list[list[int]]) -> None:
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(length.sum()))
        at, n = self.entries.size, self.entries.size + len(rows)
        while n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[at:n] = self.used + np.cumsum(length) - length
        self.length[at:n] = length
        self.used += len(ids)

    def rows(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the column, and where each text's begin."""
        if self.entries.full() or self.used > 32 * self.entries.most:
            self.clear()
        low, begins = normalised(array)
        points, starts, ends = pre_tokens(low)

        def make(where):
            self.add(self.encode([low[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]))

        found = self.entries.spans(points, starts, ends, make)
        length = self.length[found]
        cuts = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, begins)]
        return self.ids[ragged(self.begin[found], length)], cuts


def special_parts(text: str, specials: dict[str, int]) -> list[str | int]:
    """The text between special strings, and their ids; the leftmost string first, the longest of those that start there."""
    if not specials:
        return [text]
    parts = re.split(f"({'|'.join(map(re.escape, sorted(specials, key=len, reverse=True)))})", text)
    return [specials[p] if k % 2 else p for k, p in enumerate(parts)]


def encoded(table: WordTable, array: pa.Array, specials: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every row, one after the other, and their bounds; rows with special strings are encoded part by part."""
    data, offsets = utf8(array)
    raw = data.tobytes()
    if not any(s.encode() in raw for s in specials):
        return table.rows(array)
    parts, owner = [], []
    for k, text in enumerate(array.fill_null("").to_pylist()):
        for p in special_parts(text, specials):
            parts.append(p)
            owner.append(k)
    ids, cuts = table.rows(pa.array([p if isinstance(p, str) else "" for p in parts], pa.string()))
    special = np.array([k for k, p in enumerate(parts) if not isinstance(p, str)], np.int64)
    ids = np.insert(ids, cuts[special], [parts[k] for k in special.tolist()])
    length = np.diff(cuts)
    length[special] = 1
    total = np.bincount(np.array(owner, np.int64), length, len(array)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(total)])
