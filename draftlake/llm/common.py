"""Shared helpers of the training-data operators: ragged numpy text kernels, the shared folder, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Characters that one numpy pass holds at a time; bounds the memory of a Python worker.
CHUNK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """Let no Arrow batch of this session hold more rows or bytes than that, one row at least; smaller settings stay.

    Spark reads these settings when a plan runs, so they cannot be put back here.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(conf.get(key).rstrip("bB")) <= most:
            conf.set(key, str(most))
    return df


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read, so that extra columns never reach Python."""
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="draftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/draftlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_of(key: Column) -> Column:
    """A number from 0 to 1 that a hash of the key gives, fine enough for samples of any table."""
    return F.xxhash64(key).bitwiseAND((1 << 63) - 1).cast("double") / float(1 << 63)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without copies; a null row is empty."""
    if array.null_count:
        array = array.fill_null("")
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
        width = np.int64
    else:
        array = array.cast(pa.binary())
        width = np.int32
    _, offsets, data = array.buffers()
    n = len(array)
    offs = np.frombuffer(offsets, width, n + 1, array.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, U64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(step, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span: differences of one prefix sum of a polynomial.

    Spans may overlap. Some sequences collide by their structure (Thue-Morse words), so whoever uses it compares what
    it finds, or gives it values that are well mixed and short spans.
    """
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


#: A random number for each byte at each of 64 places.
_PLACES = 64
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, _PLACES * 256, U64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end], bytes, for each span: a sum of random numbers named by byte and place.

    Unlike a polynomial it has no structure that sequences could collide by: two spans agree by chance only.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), U64)
    some = np.flatnonzero(lengths > 0)
    if not len(some):
        return out
    size = lengths[some]
    before = np.cumsum(size) - size
    flat = np.arange(int(size.sum()), dtype=np.int64)
    place = flat - np.repeat(before, size)
    cell = place & (_PLACES - 1)
    cell <<= 8
    cell += data[flat + np.repeat(starts[some] - before, size)]
    h = _TABLE[cell]
    if int(size.max()) > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        with np.errstate(over="ignore"):
            h[far] *= mix(place[far] >> 6) | U64(1)
    with np.errstate(over="ignore"):
        out[some] = mix(np.add.reduceat(h, before) + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def equal_spans(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether x[at : at + length] and y[there : there + length] are the same, for each of the spans; none is empty."""
    if not len(at):
        return np.zeros(0, bool)
    same = x[ragged(at, lengths)] == y[ragged(there, lengths)]
    return np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)


class Entries:
    """What has been computed for keys, in a direct-mapped table of bounded size.

    find() gives each key's entry number and hands the keys that it does not know, once each, to `make`, which adds
    one entry for each. A key that another has displaced is made again: the table only saves work. The keys of find()
    are 64-bit numbers that name what they stand for exactly; spans() takes sequences of symbols and compares them.
    """

    def __init__(self, bits: int = 20, most: int = 400_000):
        self.shift, self.most = U64(64 - bits), most
        self.keys = np.zeros(1 << bits, U64)
        self.numbers = np.full(1 << bits, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.numbers.fill(-1)
        self.size = self.used = 0
        self.symbols = np.zeros(1 << 16, np.uint32)  # of the entries whose key is a hash, one after the other
        self.begin = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)

    def full(self) -> bool:
        return self.size > self.most or self.used > 64 * self.most

    def find(self, keys: np.ndarray, make: Callable[[np.ndarray], None]) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        found = np.where(self.keys[slot] == keys, self.numbers[slot], -1)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            make(missing[first])
            found[missing] = self._number(new)[back]
        return found

    def _number(self, new: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.size, self.size + len(new), dtype=np.int32)
        self.size += len(new)
        slot = (new >> self.shift).astype(np.int64)
        self.keys[slot], self.numbers[slot] = new, numbers
        return numbers

    def spans(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, make: Callable[[np.ndarray], None]) -> np.ndarray:
        """The entry of each points[start:end]. Up to seven symbols below 256 are a key by themselves, others are compared."""
        lengths = ends - starts
        keys, exact = np.zeros(len(starts), U64), lengths <= 7
        for k in range(7):
            own = np.flatnonzero(exact & (lengths > k))
            if not len(own):
                break
            p = points[starts[own] + k]
            keys[own] |= p.astype(U64) << U64(8 * k)
            exact[own[p > 255]] = False
        keys |= lengths.astype(U64) << U64(56)
        hashed = np.flatnonzero(~exact)
        if len(hashed):
            keys[hashed] = span_hashes(points, starts[hashed], ends[hashed]) | U64(15 << 60)
        keys = mix(keys)  # one to one
        slot = (keys >> self.shift).astype(np.int64)
        found = np.where(self.keys[slot] == keys, self.numbers[slot], -1)
        known = hashed[found[hashed] >= 0]
        found[known[~self._same(points, starts[known], lengths[known], found[known])]] = -1
        left = np.flatnonzero(found < 0)
        while len(left):
            new, first, back = np.unique(keys[left], return_index=True, return_inverse=True)
            rep = left[first]
            make(rep)
            self._keep(points, starts[rep], np.where(exact[rep], 0, lengths[rep]))
            found[left] = self._number(new)[back]
            check = left[~exact[left]]
            other = check[~self._same(points, starts[check], lengths[check], found[check])]
            found[other] = -1
            left = other
        return found

    def _keep(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the symbols of the next entries; those of length 0 are known by their key."""
        more, n = int(lengths.sum()), self.size + len(starts)
        while self.used + more > len(self.symbols):
            self.symbols = np.concatenate([self.symbols, np.zeros_like(self.symbols)])
        while n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.symbols[self.used : self.used + more] = points[ragged(starts, lengths)]
        self.begin[self.size : n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.size : n] = lengths
        self.used += more

    def _same(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = self.length[numbers] == lengths
        own = np.flatnonzero(out)
        out[own] = equal_spans(points, starts[own], self.symbols, self.begin[numbers[own]], lengths[own])
        return out


def release() -> None:
    """Give freed memory back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What workers keep between tasks only to save work; an operator that needs the memory lets it go.
KEPT: list = []


def forget() -> None:
    for kept in KEPT:
        kept.clear()
    release()


def batches(rows: Iterator[pa.RecordBatch], fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Apply fn to slices of each batch that hold about CHUNK bytes of text."""
    for batch in rows:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        for a, b in chunks(offsets):
            out = fn(batch.slice(a, b - a))
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in schema], schema=schema)
    release()
