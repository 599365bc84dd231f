"""Operator 4: a Bradley-Terry quality score learned from preference pairs.

Each labelled good text is preferred to each labelled bad one. The strength of a text is linear in its features, and
the weights minimise the logistic loss on feature differences of drawn pairs. A quantile of the training strengths
becomes the threshold, and the score is the logistic function of the distance to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import batches, chunks, id_and_text, release, share_of, small_batches, span_hashes, utf8

#: Byte classes: white space, line end, lower, upper, digit, ., ',', other sentence marks, quotes, brackets, |, !, and the rest.
_KINDS = [b" \t\x0b\x0c\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"?;:", b"\"'`", b"()[]{}<>", b"|", b"!", b"#$%&*+-/=@\\^_~"]
KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _members in enumerate(_KINDS):
    KIND[list(_members)] = _k
HIGH = len(_KINDS)
KIND[:32][KIND[:32] == HIGH] = HIGH + 1
KIND[127] = HIGH + 1
N_KINDS = HIGH + 2
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
N_FEATURES = 2 * (N_KINDS + 9)


def features(array: pa.Array) -> np.ndarray:
    """A row of features for each text: shares of byte classes and of kinds of words, and their square roots."""
    data, offsets = utf8(array)
    n = np.diff(offsets)
    rows, some = len(n), n > 0
    kind = KIND[data]
    owner = np.repeat(np.arange(rows), n)
    count = np.bincount(owner * N_KINDS + kind, minlength=rows * N_KINDS).reshape(rows, N_KINDS).astype(np.float64)
    size = np.maximum(n, 1)[:, None]
    space = SPACES[data]
    start = ~space
    start[1:] &= space[:-1] | (owner[1:] != owner[:-1])
    stop = ~space
    stop[:-1] &= space[1:] | (owner[1:] != owner[:-1])
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    word = owner[starts]
    words = np.maximum(np.bincount(word, minlength=rows), 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(word[flag], minlength=rows) / words

    same = np.zeros(len(starts), bool)
    near = np.zeros(len(starts), bool)
    h = span_hashes(data, starts, stops)
    same[1:] = (h[1:] == h[:-1]) & (word[1:] == word[:-1])
    near[2:] = (h[2:] == h[:-2]) & (word[2:] == word[:-2])
    first, last = kind[starts], kind[stops - 1]
    length = stops - starts
    symbol = HIGH - 1
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & (owner[1:] == owner[:-1]) & (kind[1:] >= 5) & (kind[1:] < HIGH)
    more = [
        share(same), share(near), share(last == symbol), share((first == 3) & (last == 3) & (length > 1)), share((first == 10) & (length == 1)), share(last == 11), share(length > 20),
        np.bincount(owner[doubled], minlength=rows) / size[:, 0], np.minimum(np.bincount(word, minlength=rows) / size[:, 0] * 4, 1),
    ]
    x = np.column_stack([count / size, *more])
    x[~some] = 0
    return np.hstack([x, np.sqrt(x)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.spread, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, rounds: int = 40) -> Model:
    """Weights from drawn pairs (good, bad); without both kinds of labels every text scores 0.5."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    weight = np.zeros(x.shape[1] if x.size else N_FEATURES)
    if not len(up) or not len(down):
        return Model(mean, scale, weight, 0.0, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(0)
    k = min(pairs, len(up) * len(down))
    gap = z[rng.choice(up, k)] - z[rng.choice(down, k)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(gap @ weight, -60, 60)))  # of the wrong order
        slope = ridge * weight - gap.T @ p / k
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / k + ridge * np.eye(len(weight))
        step = np.linalg.solve(bend, slope)
        weight = weight - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weight
    grid = np.linspace(0, 1, 2001)[1:-1]
    cuts = np.quantile(s, grid, method="midpoint")
    below_bad = np.searchsorted(np.sort(s[down]), cuts, "left") / len(down)
    above_good = 1 - np.searchsorted(np.sort(s[up]), cuts, "left") / len(up)
    value = len(down) * below_bad + len(up) * above_good
    best = np.flatnonzero(value == value.max())
    threshold = float(cuts[best[len(best) // 2]])
    return Model(mean, scale, weight, threshold, calibrated(s - threshold, good))


def calibrated(distance: np.ndarray, good: np.ndarray) -> float:
    """The spread by which the logistic function of distance / spread fits the labels best (least log loss, a grid)."""
    unit = float(max(np.std(distance), 1e-9))
    spreads = unit * np.exp2(np.linspace(-6, 4, 81))
    signed = np.where(good, distance, -distance)
    loss = [np.logaddexp(0, -signed / x).mean() for x in spreads]
    return float(spreads[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """Fit on about `most` labelled rows at most, chosen by a hash of doc_id; rows of the held-out third are not read.

    A document with contradicting labels, a null label or a null doc_id teaches nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    total = known.count()
    if total > most:
        known = known.where(share_of(F.col("doc_id")) < most / total)
    # at most about `most` ids of 12 bytes: a bounded broadcast
    chosen = id_and_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> dict:
            x = features(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())}

        yield from batches(rows, one, schema)

    got = chosen.mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")]).combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    return fit(x.reshape(-1, N_FEATURES), got.column("quality").to_numpy() == 1)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    A null or empty text has score 0. A null doc_id is kept and not held out; repeated rows give repeated results; an
    empty table gives none. Texts of any length are read whole; equal texts score equally, so ties change nothing. With `keep`, those columns of docs are returned too in a struct `kept`, and text beside it;
    no other column is read.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")]
    own = small_batches(docs).select(*columns, *([F.struct(*keep).alias("kept")] if keep else []))
    kept = [f"kept {own.schema['kept'].dataType.simpleString()}", "text string"] if keep else []

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            parts = []
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                s = model.score(features(batch.column("text").slice(a, b - a)))
                s[np.diff(offsets[a : b + 1]) == 0] = 0.0
                parts.append(s)
            s = np.concatenate(parts) if parts else np.zeros(0)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            names = ["doc_id", "held_out", "score", "predicted"]
            if keep:
                out, names = [*out, batch.column("kept"), batch.column("text")], [*names, "kept", "text"]
            yield pa.RecordBatch.from_arrays(out, names=names)
        release()

    return own.mapInArrow(run, ", ".join([SCHEMA, *kept]))
