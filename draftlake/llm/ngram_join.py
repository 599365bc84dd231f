"""Operator 2: exact Jaccard self-join of word-shingle sets by universe partitioning.

A set is cut into segments by the hash range of its elements. Sets of one size band use the same number of segments, so
that two similar sets, whose symmetric difference is at most (r + s) (1 - t) / (1 + t) elements, cannot differ in all
of them: with a tolerance t_i for segment i and sum(t_i + 1) above that bound, some segment differs by at most t_i
elements. Tolerance 0 is an equal segment; tolerance 1, allotted to the first few segments, is met by indexing the
segment and all its subsets less one element; an empty segment has tolerance -1 and is not indexed, since it would
match without cause. How many segments a band has and how many get tolerance 1 is chosen by cost: rows in the index,
and the chance that a segment holds nothing but a passage that many sets share.

Index entries travel as blocks of a narrow slice of the signatures, sorted by slice, so that a task holds one slice at a
time. Buckets give candidates: each member with the bucket's least one, first, in an order that depends on the
signature. What is left are buckets whose members do not yet lie in one component: where the pairs across components are
few for the members, all of these pairs; the others, and sets whose empty segments exceed the allotment, are
joined by prefixes in order of frequency, which is exact as well. Every candidate is verified on the words of the whole
texts. Equal sets are one node from the start: nodes are 64-bit digests, a second digest finds sets that share one by
chance, and these are parted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import U64, byte_hashes, chunks, forget, id_and_text, mix, partitions, ragged, release, shared_table, utf8

WORDS = 5
NUM, DEN = 80, 100  # the threshold as a fraction
BITS, QUICK = 1024, 16
ENTRY = np.dtype([("sig", "<u8"), ("node", "<u8")])
#: Index entries that a task holds before it sends them on or pairs them; pairs across components, as a multiple of a
#: bucket's members, up to which all are tried: a pair's parities cost about as much as a three-hundredth of a set's way
#: through the prefix join, which sends every element of a set through three shuffles.
HELD, FEW = 200_000, 1024
#: Orders of the nodes, by the signature, of which each gives its buckets another least node; a power of two.
LEADERS = 32
#: Bytes of text that a task hashes at a time, and slices of the signatures for each shuffle partition.
TEXT, SLICES = 200_000, 16
#: Rows of a few longs up to which they are broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 300_000
#: Pairs of one leader that a task verifies; more are dealt to several, each with the leader's text.
SHARE = 2000
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LOWER = FOLD.tobytes()


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and the texts' numbers of them."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    space = SPACE[data]
    edge = np.ones(len(data), bool)
    edge[1:] = owner[1:] != owner[:-1]
    start, stop = ~space, ~space
    start[1:] &= space[:-1] | edge[1:]
    stop[:-1] &= space[1:] | edge[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    word = byte_hashes(FOLD[data], starts, stops)
    of = owner[starts]
    count = np.bincount(of, minlength=len(n))
    first = np.cumsum(count) - count
    out, sizes = [], np.zeros(len(n), np.int64)
    mixed = np.zeros(max(0, len(word) - WORDS + 1), U64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            mixed = mixed * U64(0x9E3779B97F4A7C15) + word[k : k + len(mixed)]
    mixed = mix(mixed)
    for i in range(len(n)):
        a, c = int(first[i]), int(count[i])
        if c >= WORDS:
            own = np.unique(mixed[a : a + c - WORDS + 1])
        elif c:
            own = mix(np.array([sum(int(x) * pow(3, 40 * k + 1, 1 << 64) for k, x in enumerate(word[a : a + c].tolist())) + c & (1 << 64) - 1], U64))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), sizes


@lru_cache(1)
def bands(most: int = 1 << 40) -> np.ndarray:
    """Least size of each band: a set's smaller partners lie in its own band or the one below."""
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, low[-1] * DEN // NUM))
    return np.array(low, np.int64)


@lru_cache(4096)
def allotment(band: int) -> tuple[int, int, int]:
    """Segments, how many of them have tolerance 1, and the sum of t_i + 1 that is needed, for sets up to this band."""
    low = bands()
    least, most = int(low[max(0, band - 1)]), int(low[band + 1]) - 1
    bound = 2 * most * (DEN - NUM) // (DEN + NUM)
    best = None
    for slack in range(0, 6 + bound // 4):
        m = bound + 1 + slack
        load = least / m
        empty = m * math.exp(-load)
        spare = math.ceil(empty + 3 * math.sqrt(empty) + 0.5)
        soft = min(m, max(0, spare - slack))
        cost = m + soft * (1 + load) + 20 * m * math.exp(-0.7 * load)
        if best is None or cost < best[0]:
            best = cost, m, soft
    return best[1], best[2], bound + 1


def index(values: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of sets, and which of them have too many empty segments for their allotment in some band."""
    out, short = [], np.zeros(len(sizes), bool)
    own_band = np.searchsorted(bands(), sizes, "right") - 1
    element = mix(values ^ U64(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for up in (0, 1):
        plan = np.array([allotment(int(b) + up) for b in np.unique(own_band)]).reshape(-1, 3)
        plan = plan[np.searchsorted(np.unique(own_band), own_band)]
        m, soft, need = plan.T
        segment = ((values >> U64(32)) * np.repeat(m, sizes).astype(U64)) >> U64(32)
        segment = segment.astype(np.int64)
        edge = np.ones(len(values), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(edge)
        length = np.diff(np.append(at, len(values)))
        who, which = owner[at], segment[at]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(element, at) if len(at) else np.zeros(0, U64)
            salt = which.astype(U64) * U64(0xE7037ED1A0B428DB) + (own_band[who] + up + 1).astype(U64) * U64(0x8EBC6AF09C88C6E3)
        live = need[who] > 1
        double = live & (which < soft[who]) & (length > 1)
        tolerance = np.bincount(who[live], minlength=len(sizes)) + np.bincount(who[double], minlength=len(sizes))
        short |= (tolerance < need) & (need > 1)
        with np.errstate(over="ignore"):
            made = [(mix(total[live] + salt[live]), nodes[who[live]])]
            if double.any():
                part = np.repeat(np.flatnonzero(double), length[double])
                made.append((mix(total[part] - element[ragged(at[double], length[double])] + salt[part]), nodes[who[part]]))
        for sig, node in made:
            e = np.empty(len(sig), ENTRY)
            e["sig"], e["node"] = sig, node
            out.append(e)
    return (np.concatenate(out) if out else np.empty(0, ENTRY)), short


def digests(values: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A node for each set; the empty set has node 0. Another seed gives independent digests."""
    out = np.zeros(len(sizes), U64)
    some = sizes > 0
    if some.any():
        begin = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            out[some] = mix(np.add.reduceat(mix(values + U64(seed)), begin) + sizes[some].astype(U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    return out


def parities(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each set, the parity of its elements in cells, BITS or more for larger sets, a power of two.

    Two sets differ by at least as many elements as their parities do; halves laid over one another give fewer cells.
    """
    if not len(sizes):
        return []
    cells = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.cumsum(cells) - cells
    cell = np.repeat(begin, sizes) + (values & np.repeat(cells - 1, sizes).astype(U64)).astype(np.int64)
    odd = np.bincount(cell, minlength=int(cells.sum())).astype(np.uint8) & 1
    packed = np.packbits(odd).view(np.int64)
    return np.split(packed, begin[1:] // 64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def quick(a: str, b: str) -> Column:
    """Whether sizes and parities of cells taken together leave a pair possible: a bound on the sets' difference."""
    x, y = F.col(f"size_{a}"), F.col(f"size_{b}")
    differ = sum((F.bit_count(F.col(f"q{k}_{a}").bitwiseXOR(F.col(f"q{k}_{b}"))) for k in range(1, QUICK)), F.bit_count(F.col(f"q0_{a}").bitwiseXOR(F.col(f"q0_{b}"))))
    return (x * DEN >= y * NUM) & (y * DEN >= x * NUM) & (differ * (DEN + NUM) <= (x + y) * (DEN - NUM))


def facts(reps: DataFrame) -> DataFrame:
    """node, size and folded parities q0 to q15 of nodes."""
    folded = [F.aggregate(F.expr(f"transform(sequence({k}, size(bits) - 1, {QUICK}), i -> bits[i])"), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"q{k}") for k in range(QUICK)]
    return reps.select("node", "size", *folded)


def named(df: DataFrame, to: str, same: tuple[str, ...] = ()) -> DataFrame:
    """df with _<to> after the names of its columns but those in `same`; node is <to> itself."""
    return df.select(*[F.col(c).alias(c if c in same else to if c == "node" else f"{c}_{to}") for c in df.columns])


MEMBER = "doc_id long, mark long, node long, check long, size long, short boolean, bits array<long>"
ROUTED = f"slice int, {MEMBER}, entries binary"
FOUND = f"{MEMBER}, sig long, leader long, members long"


def fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows of one doc_id apart."""
    return id_and_text(docs).withColumn("mark", F.xxhash64("text"))


def route(docs: DataFrame, slices: int) -> DataFrame:
    """Members, under negative slices, and for each slice of the signatures blocks of index entries."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        n_held = 0

        def flush():
            e = np.concatenate(held)
            held.clear()
            part = ((e["sig"] >> U64(32)) * U64(slices) >> U64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(slices + 1))
            full = np.flatnonzero(np.diff(cuts)).astype(np.int32)
            for a in range(0, len(full), 200):
                own = full[a : a + 200]
                blocks = [e[order[cuts[p] : cuts[p + 1]]].tobytes() for p in own]
                empty = [pa.nulls(len(own), t) for t in (*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(own), *empty, pa.array(blocks, pa.binary())], names=fields(ROUTED))

        for batch in rows:
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, TEXT):
                values, sizes = shingles(*utf8(batch.column("text").slice(a, b - a)))
                nodes, check = digests(values, sizes), digests(values, sizes, 7)
                new = np.zeros(len(sizes), bool)
                for k, x in enumerate(zip(nodes.tolist(), check.tolist(), strict=True)):
                    if sizes[k] and x not in seen:
                        seen.add(x)
                        new[k] = True
                if len(seen) > HELD:
                    seen.clear()
                pick = np.repeat(new, sizes)
                entries, lacking = index(values[pick], sizes[new], nodes[new])
                short = np.zeros(len(sizes), bool)
                short[new] = lacking
                bits: list[np.ndarray | None] = [None] * len(sizes)
                for k, b_of in zip(np.flatnonzero(new).tolist(), parities(values[pick], sizes[new]), strict=True):
                    bits[k] = b_of
                held.append(entries)
                n_held += len(entries)
                if n_held > HELD:
                    yield from flush()
                    n_held = 0
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "mark")]
                numbers = [pa.array(x.view(np.int64)) for x in (nodes, check, sizes)]
                where = pa.array((-1 - np.arange(a, b) % slices).astype(np.int32))
                yield pa.RecordBatch.from_arrays([where, *own, *numbers, pa.array(short), pa.array(bits, pa.list_(pa.int64())), pa.nulls(b - a, pa.binary())], names=fields(ROUTED))
        if held:
            yield from flush()
        release()

    return marked(docs).mapInArrow(run, ROUTED)


def paired(e: np.ndarray, carried: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of every bucket of two nodes or more, their leaders and the buckets' sizes; each bucket's leader as
    an entry, and whether it has been given out.

    `carried` are leaders of the same buckets that stand for members seen before; `told` says which were given out.
    """
    e = np.concatenate([carried, e])
    old = np.zeros(len(e), bool)
    old[: len(told)] = told
    with np.errstate(over="ignore"):
        turn = mix(e["node"] ^ (e["sig"] & U64(LEADERS - 1)) * U64(0x9E3779B97F4A7C15))
    order = np.lexsort((~old, turn, e["sig"]))
    e, old = e[order], old[order]
    again = np.zeros(len(e), bool)
    again[1:] = (e["sig"][1:] == e["sig"][:-1]) & (e["node"][1:] == e["node"][:-1])
    e, old = e[~again], old[~again]
    at = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(e)))
    keep = np.repeat(size > 1, size) & ~old
    return e[keep], np.repeat(e["node"][at], size)[keep], np.repeat(size, size)[keep], e[at], old[at] | (size > 1)


def buckets(routed: DataFrame) -> DataFrame:
    """Members as they are, and the entries of every bucket of two nodes or more with its least node.

    A slice of more than HELD entries is worked off in portions; a leader of each bucket goes on from one to the next.
    """

    def rows_of(e: np.ndarray, leader: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(e), 50_000):
            own = e[a : a + 50_000]
            empty = [pa.nulls(len(own), t) for t in (pa.int64(), pa.int64())], [pa.nulls(len(own), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))]
            numbers = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (own["sig"], leader[a : a + 50_000], members[a : a + 50_000])]
            yield pa.RecordBatch.from_arrays([*empty[0], pa.array(np.ascontiguousarray(own["node"]).view(np.int64)), *empty[1], *numbers], names=fields(FOUND))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held, current = 0, None
        none = np.empty(0, ENTRY), np.zeros(0, bool)
        carried = none

        def portion(last: bool):
            nonlocal n_held, carried
            if not held:
                return
            e = np.concatenate(held)
            held.clear()
            n_held = 0
            parted = not last or len(carried[0]) > 0
            if not parted:  # only what has a twin can make a bucket
                e = e[np.argsort(e["sig"])]
                twin = np.zeros(len(e), bool)
                twin[1:] = e["sig"][1:] == e["sig"][:-1]
                twin[:-1] |= twin[1:]
                e = e[twin]
            e, leader, members, *carried = paired(e, *carried)
            yield from rows_of(e, leader, members + 3 * parted)

        for batch in rows:
            part = batch.column("slice").to_numpy()
            rest = batch.filter(pa.array(part < 0))
            if rest.num_rows:
                empty = pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in fields(MEMBER)), empty, empty, empty], names=fields(FOUND))
            entries = batch.column("entries")
            for k in np.flatnonzero(part >= 0).tolist():
                if part[k] != current:
                    yield from portion(True)
                    current, carried = part[k], none
                held.append(np.frombuffer(entries[k].as_buffer(), ENTRY).copy())
                n_held += len(held[-1])
                if n_held > 5 * HELD:
                    yield from portion(False)
        yield from portion(True)
        release()

    return routed.repartition(partitions(routed), "slice").sortWithinPartitions("slice").mapInArrow(run, FOUND)


def picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` rows, which name documents by (doc_id, mark), with the text of each."""
    few = wanted.count() <= BROADCAST_ROWS
    return marked(docs).join(F.broadcast(wanted) if few else wanted, ["doc_id", "mark"])


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its set (ascending 64-bit hashes as bytes) for nodes (node, doc_id, mark)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, TEXT):
                values, sizes = shingles(*utf8(batch.column("text").slice(a, b - a)))
                ends = np.cumsum(sizes)
                raw = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(raw, pa.binary())], names=["node", "items"])
        release()

    return picked(docs, nodes.select("node", "doc_id", "mark")).select("node", "text").mapInArrow(run, "node long, items binary")


def plausible(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that their sizes and parities leave possible."""
    own = reps.select("node", "size", "bits")
    x, y = F.col("size_a"), F.col("size_b")
    both = pairs.join(named(own, "a"), "a").join(named(own, "b"), "b").where((x * DEN >= y * NUM) & (y * DEN >= x * NUM))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c) for c in ("bits_a", "bits_b"))
            n = [np.diff(c.offsets.to_numpy()) for c in (x, y)]
            flat = [c.flatten().to_numpy() for c in (x, y)]
            at = [np.cumsum(k) - k for k in n]
            differ = np.zeros(batch.num_rows, np.int64)
            same = np.flatnonzero(n[0] == n[1])
            if len(same):
                odd = flat[0][ragged(at[0][same], n[0][same])] ^ flat[1][ragged(at[1][same], n[1][same])]
                differ[same] = np.add.reduceat(np.bitwise_count(odd.view(np.uint64)).astype(np.int64), np.cumsum(n[0][same]) - n[0][same])
            for k in np.flatnonzero(n[0] != n[1]).tolist():
                differ[k] = differing(*(f[i[k] : i[k] + m[k]] for f, i, m in zip(flat, at, n, strict=True)))
            keep = pa.array(differ * (DEN + NUM) <= batch.column("total").to_numpy() * (DEN - NUM))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])

    return both.select("a", "b", (x + y).alias("total"), "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def word_shingles(text: bytes, ids: dict[bytes, int]) -> set[tuple[int, ...]]:
    """The set of a text, its words replaced by numbers of their own."""
    words = [ids.setdefault(w, len(ids)) for w in text.translate(LOWER).split()]
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False))


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, word by word on the whole texts.

    Each b is sent to its leader a; leaders of many pairs stand at several places.
    """
    pairs = shared_table(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SHARE)
    dealt = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SHARE)), F.lit(0)).cast("int").alias("salt"))
    leaders = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    wanted = leaders.union(dealt.select("a", "salt", "b", F.col("b").alias("node"))).join(reps.select("node", "doc_id", "mark"), "node")
    texts = picked(docs, wanted.drop("node")).select("a", "salt", "b", F.col("text").cast("binary").alias("text"))
    sent = texts.repartition(partitions(docs), "a", "salt").sortWithinPartitions("a", "salt", "b")  # a null b, the leader, first

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own, ids = None, set(), {}
        for batch in rows:
            got = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                if b is None:
                    if a != leader or len(ids) > HELD:
                        ids = {}
                    leader, own = a, word_shingles(raw, ids)
                    continue
                other = word_shingles(raw, ids)
                if DEN * min(len(own), len(other)) < NUM * max(len(own), len(other)):
                    continue
                common = len(own & other)
                if DEN * common >= NUM * (len(own) + len(other) - common):
                    got.append((a, b))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return shared_table(sent.select("a", "b", "text").mapInArrow(run, "a long, b long").distinct(), "links")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component for every node of a link: rounds of taking the least neighbour and contracting.

    `known` are the components of other links, to which these are added.
    """
    labels, edges = known, links.select("a", "b")
    if known is not None:
        for end in "ab":
            edges = edges.join(named(known, end), end, "left").select(F.coalesce(f"component_{end}", end).alias(end), "a" if end == "b" else "b")
        edges = shared_table(edges.where("a != b").distinct(), "edges")
    while labels is None or not edges.isEmpty():
        two = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = shared_table(two.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            moved = labels.join(after, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = shared_table(moved.union(step.join(labels, "node", "left_anti").select("node", "component")), "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        edges = shared_table(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of their node; a node without links is its own."""
    few = labels.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(labels) if few else labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def prefix_pairs(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates among nodes (node, component): those of different components that share an item of their prefixes."""
    sets = sets_of(docs, reps.join(nodes, "node", "left_semi")).dropDuplicates(["node"])  # a repeated row would count twice

    def items(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(own), pa.array(np.full(len(own), len(own), np.int64))], names=["node", "item", "size"])

    flat = shared_table(sets.mapInArrow(items, "node long, item long, size long"), "items")
    ranked = flat.join(flat.groupBy("item").agg(F.count("*").alias("n")), "item").where("n > 1 or size = 1")
    # items of one set only sort first and cannot match: a rank among the rest starts after them
    alone = F.col("size") - F.count("*").over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("n", "item")) + alone
    length = F.col("size") - F.ceil(F.col("size") * NUM / DEN) + 1
    prefix = ranked.withColumn("rank", rank).where(F.col("rank") <= length).select("node", "item", "rank")
    prefix = shared_table(prefix.join(nodes, "node"), "prefixes")
    a, b = (prefix.select("item", F.col("node").alias(x), F.col("component").alias(f"in_{x}"), F.col("rank").alias(f"rank_{x}")).join(named(facts(reps), x), x) for x in "ab")
    # what the first common item leaves after its place in either set must suffice
    rest = 1 + F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b"))
    fits = (F.col("in_a") != F.col("in_b")) & (F.col("a") < F.col("b")) & (rest * (DEN + NUM) >= (F.col("size_a") + F.col("size_b")) * NUM) & quick("a", "b")
    return a.join(b, "item").where(fits).select("a", "b").distinct()


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 |A and B| >= 80 |A or B| for their sets of 5-word shingles; a document of fewer words is
    one shingle. component_id is the smallest doc_id reachable by links. A null, empty or blank text has no shingles and
    is linked with nothing. Rows that share a doc_id are documents of their own, repeated rows get equal results. A row
    with a null doc_id is kept and makes no links; its component is that of the documents with its set, else null. An
    empty table gives no rows. Texts of any length are read whole. Ties cannot arise: the least doc_id of a component is
    one number. Columns other than doc_id and text are not read.
    """
    found = shared_table(buckets(route(docs, SLICES * partitions(docs))), "buckets")
    members = found.where("sig is null").select(*fields(MEMBER))
    entries = found.where("sig is not null").select("sig", "node", "leader", "members")
    twice = shared_table(members.where("size > 0").groupBy("node").agg(F.min("check").alias("first"), F.max("check").alias("other")).where("first != other"), "twice")
    direct = None
    if not twice.isEmpty():  # different sets of one digest: all but the first get nodes and entries of their own
        other = members.where("size > 0").join(twice, "node").where("check != first").select("node", "check").distinct()
        other = shared_table(other.withColumn("own", F.xxhash64(F.lit(1), "node", "check").bitwiseOR(F.lit(1))), "parted")
        members = members.join(other, ["node", "check"], "left").withColumn("node", F.coalesce("own", "node")).select(*fields(MEMBER))
        more = entries.join(other, "node").select("sig", F.col("own").alias("node"), "leader", F.lit(3).cast("long").alias("members"))
        entries = entries.withColumn("members", F.col("members") + 3).union(more)
        direct = other.select(F.col("node").alias("a"), F.col("own").alias("b"))
        # a leader stands for all that share its digest
        led = entries.join(other.select(F.col("node").alias("leader"), "own"), "leader").where("own != node").select(F.col("own").alias("a"), F.col("node").alias("b"))
        direct = direct.union(led).union(other.alias("x").join(other.alias("y"), "node").where("x.own < y.own").select(F.col("x.own").alias("a"), F.col("y.own").alias("b")))
    # the row of a node that has its bits may be one without a doc_id
    reps = members.where("size > 0").groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("rep"), F.max("size").alias("size"), F.max("short").alias("short"), F.max("bits").alias("bits"))
    reps = shared_table(reps.where("rep is not null").select("node", "rep.doc_id", "rep.mark", "size", "short", "bits"), "nodes")
    pairs = entries.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = shared_table(plausible(reps, (pairs if direct is None else pairs.union(direct)).distinct()), "plausible")
    # a first star for each node; then its other pairs, unless stars have brought them together
    stars = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(docs, reps, stars)
    up = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    more = pairs.join(stars, ["a", "b"], "left_anti")
    for end in "ab":
        more = labelled(labelled(more.withColumn("node", F.col(end)), up).withColumn("node", F.col("component")).drop("component"), up).withColumnRenamed("component", f"in_{end}").drop("node")
    more = verified(docs, reps, more.where("in_a != in_b").select("a", "b"))
    links = links.union(more)
    labels = components(links)
    # buckets of three and more that still span components
    wide = labelled(entries.where("members > 2").select("sig", "node"), labels)
    spread = wide.groupBy("sig", "component").agg(F.count("*").alias("n"))
    spread = spread.groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("components")).where("components > 1")
    # pairs of members across components and within them
    n, within = F.col("n"), F.col("within")
    across = (n.cast("double") * n - within) / 2
    way = F.when((across <= FEW * n) & (within <= 2 * across), "members").when(across <= FEW // 64 * n, "components").otherwise("prefixes")
    wide = shared_table(wide.join(spread.select("sig", way.alias("way")), "sig").select("sig", "node", "component", "way"), "wide")
    known = [wide.where(F.col("way") == w).select("sig", "node", "component").join(facts(reps), "node") for w in ("members", "components")]
    one, two = (named(known[0], x, ("sig",)) for x in "ab")
    members_of = one.join(two, "sig").where((F.col("component_a") != F.col("component_b")) & (F.col("a") < F.col("b")) & quick("a", "b")).select("a", "b")
    # where a large component would meet itself, by pairs of components
    one, two = (known[1].select("sig", F.col("component").alias(f"component_{x}")).distinct() for x in "ab")
    apart = one.join(two, "sig").where("component_a < component_b")
    for x in "ab":
        apart = apart.join(named(known[1], x, ("sig",)), ["sig", f"component_{x}"])
    apart = apart.where(quick("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last = members_of.union(apart).distinct()
    hot = wide.where("way = 'prefixes'").select("node").union(reps.where("short").select("node")).distinct()
    hot = shared_table(labelled(hot, labels), "hot")
    if not hot.isEmpty():
        last = last.union(prefix_pairs(docs, reps, hot)).distinct()
    labels = components(verified(docs, reps, plausible(reps, last)), labels)
    whole = labelled(reps.select("node", F.col("doc_id").alias("rep")), labels)
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = whole.join(least, "component").select("node", "component_id")
    own = F.when(F.col("size") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return members.select("doc_id", "node", "size").join(names, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
