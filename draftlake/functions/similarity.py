"""Similarity of texts, sets and vectors."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.functions.text import token_set


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def clamped_dot(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def keyword_score(text: Column, terms: list[str]) -> Column:
    """Occurrences of the terms over a length penalty."""
    own = F.lower(text)
    hits = sum(((F.length(own) - F.length(F.replace(own, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return hits / (1 + F.length(text) / 400)


def gram_sequence(text: Column) -> Column:
    """Trigrams of the words in order, with repeats; words are padded with two blanks before and one behind."""

    def of(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]+"), F.lit(0)), of))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words."""
    return F.array_distinct(gram_sequence(text))


def trigram_bound(query: Column, text: Column) -> Column:
    """Upper bound of word_similarity, for a native filter before it."""
    n = F.size(trigrams(query))
    return F.when(n > 0, F.size(F.array_intersect(trigrams(query), trigrams(text))) / n).otherwise(0.0)


def extent_similarity(wanted: Column, sequence: Column) -> Column:
    """Largest share of the wanted trigrams over those of a continuous extent of a trigram sequence.

    Only extents from one wanted trigram to another need a look: a longer one has more to unite and no more to share.
    Meant for names and labels: the work grows with the square of the wanted trigrams that a text holds.
    """
    hits = F.filter(F.sequence(F.lit(1), F.size(sequence)), lambda i: F.array_contains(wanted, F.element_at(sequence, i)))

    def share(start: Column, end: Column) -> Column:
        extent = F.slice(sequence, start, end - start + 1)
        common = F.size(F.array_intersect(extent, wanted))
        return common / (F.size(wanted) + F.size(F.array_distinct(extent)) - common)

    from_start = lambda at, i: F.array_max(F.transform(F.slice(at, i + 1, F.size(at)), lambda end: share(F.get(at, i), end)))
    best = let(hits, lambda at: F.array_max(F.transform(at, lambda _, i: from_start(at, i))))
    known = F.when((F.size(sequence) > 0) & (F.size(wanted) > 0), best)
    return F.when(wanted.isNotNull() & sequence.isNotNull(), F.coalesce(known, F.lit(0.0)))


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_similarity(query: Column, text: Column) -> Column:
    """Similarity of a query to the best extent of a text, 0 to 1; null if either is null."""
    return let(trigrams(query), lambda wanted: let(gram_sequence(text), lambda sequence: extent_similarity(wanted, sequence)))


def lexical_score(text: Column, terms: list[str]) -> Column:
    """Mean over the terms of 1 if contained, else 0.8 of the trigram similarity, 0 for terms under 3 characters."""
    parts = []
    for t in terms:
        near = word_similarity(F.lit(t), text) * 0.8 if len(t) >= 3 else F.lit(0.0)
        parts.append(F.when(F.contains(F.lower(text), F.lit(t.lower())), 1.0).otherwise(near))
    return sum(parts, F.lit(0.0)) / max(1, len(parts))


def contained_score(text: Column, terms: list[str]) -> Column:
    """The lexical score without its trigram part: share of the terms that the text contains."""
    own = F.lower(text)
    return sum((F.when(F.contains(own, F.lit(t.lower())), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(1, len(terms))


def hybrid_score(lexical: Column, vector: Column, domain_kind: Column) -> Column:
    """0.6 lexical, 0.4 vector, 0.05 for kinds that are not generic; no vector leaves the lexical weight as it is."""
    return 0.6 * lexical + 0.4 * F.coalesce(vector, F.lit(0.0)) + F.when(domain_kind, 0.05).otherwise(0.0)


def memory_score(query: Column, own: Column, project: Column, cosine_: Column | None = None) -> Column:
    """(2 |query and object| + |query and project|) / max(2 |query|, 1), 0.25 of the cosine on the vector route, 1 at most."""
    overlap = (2 * F.size(F.array_intersect(query, own)) + F.size(F.array_intersect(query, project))) / F.greatest(2 * F.size(query), F.lit(1))
    return F.least(F.lit(1.0), overlap + (F.lit(0.0) if cosine_ is None else 0.25 * cosine_))


def hash_buckets(text: Column, width: int = 64) -> Column:
    """Bucket of each distinct token: the first 8 bytes of its SHA-256 modulo the width."""
    value = lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, 10).cast("decimal(38,0)")
    return F.transform(token_set(text), lambda t: F.pmod(value(t), F.lit(width).cast("decimal(38,0)")).cast("int"))


def hash_vector(text: Column, width: int = 64) -> Column:
    """Unit vector of token buckets, rounded to 8 places; zeros for a text without tokens."""
    zeros = F.array_repeat(F.lit(0.0), width)

    def add(counts, bucket):
        return F.transform(counts, lambda x, i: F.when(i == bucket, x + 1).otherwise(x))

    def unit(counts):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm > 0, F.transform(counts, lambda x: F.round(x / norm, 8))).otherwise(counts)

    return F.aggregate(hash_buckets(text, width), zeros, add, unit)


@lru_cache(1 << 16)
def token_seed(token: str) -> bytes:
    """Sixteen pairs of bytes; short tokens recur, so that the last ones are kept."""
    return hashlib.sha256(token.encode()).digest()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def signed_hash_vector(text: pd.Series) -> pd.Series:
    """1024 dimensions, 16 signed bumps for each token with repeats; unit length, rounded to 6 places; e0 if empty.

    A token is whatever stands between white space, in any script; a text of white space alone is one token itself.
    """
    from collections import Counter

    import numpy as np

    def one(t: str | None):
        low = (t or "").lower()
        n = Counter(low.split() or [low] * bool(low))
        seeds = [token_seed(x) if len(x) <= 64 else token_seed.__wrapped__(x) for x in n]
        pairs = np.frombuffer(b"".join(seeds), np.uint8).reshape(-1, 2).astype(np.int64)
        v = np.bincount((pairs[:, 0] * 256 + pairs[:, 1]) % 1024, (pairs[:, 0] - 128) / 128 * np.repeat(list(n.values()), 16), 1024)
        norm = np.linalg.norm(v)
        if norm <= 1e-9:
            v, norm = np.eye(1, 1024)[0], 1.0
        return np.round(v / norm, 6).astype(np.float32)

    return text.map(one)


def usable_vector(v: Column, dim: int) -> Column:
    """Right dimension, finite, within half precision, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 65504.0))
    return (F.size(v) == dim) & fine & (F.sqrt(dot(v, v)) > 1e-9)
