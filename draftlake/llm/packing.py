"""Operator 1: best-fit packing of token pieces into sequences by bin completion.

Only the number of pieces of each length matters for the plan, so the driver plans on a histogram of at most
`capacity` rows, whatever the number of documents. The plan is a list of patterns (how many pieces of which lengths
share a sequence) with multiplicities; each piece then finds its sequence from its rank among the pieces of its length.

The planner is bin completion by branch and bound. A node completes the sequence around the largest piece left; its
children are the undominated fillings of the space beside it, best fit (least waste) first, each applied as often as
the counts allow. The first dive gives the incumbent; a node is cut when the waste so far forces as many sequences as
the incumbent has. The search ends at the lower bound ceil(tokens / capacity) or after a number of nodes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import batches, id_and_text, release, shared_table
from draftlake.llm.word_bpe import WordTable, encoded, special_tokens

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # multiplicity, (length, copies) from the largest length down


class Planner:
    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = 20_000, looks: int = 300):
        self.capacity, self.nodes, self.looks = capacity, nodes, looks
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.count)
        self.left = sum(n * c for n, c in self.count.items())
        self.bound = -(-self.left // capacity)

    def fits(self, room: int) -> int:
        """The largest length left that fits the room, 0 if none."""
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0

    def apply(self, pattern: Pattern, sign: int) -> None:
        times, parts = pattern
        for n, k in parts:
            old = self.count.get(n, 0)
            new = old + sign * times * k
            self.count[n] = new
            self.left += sign * times * k * n
            if not old:
                insort(self.lengths, n)
            elif not new:
                self.lengths.pop(bisect_right(self.lengths, n) - 1)

    def fillings(self, most: int) -> list[Pattern]:
        """Undominated completions of a sequence that holds the largest piece left, the least waste first."""
        largest = self.lengths[-1]
        used = {largest: 1}
        found: dict[tuple, int] = {}
        looks = self.looks

        def record(own: dict[int, int], room: int) -> None:
            found.setdefault(tuple(sorted(((n, k) for n, k in own.items() if k), reverse=True)), room)

        def finish(room: int) -> None:
            """Record the filling with the largest pieces that still fit."""
            own = dict(used)
            for n in reversed(self.lengths[: bisect_right(self.lengths, room)]):
                k = min(self.count[n] - own.get(n, 0), room // n)
                own[n] = own.get(n, 0) + k
                room -= k * n
            record(own, room)

        def search(room: int, top: int, all_fit: bool) -> None:
            nonlocal looks
            looks -= 1
            if looks <= 0:
                finish(room)
                return
            at = bisect_right(self.lengths, min(room, top))
            grew = False
            while at:
                at -= 1
                n = self.lengths[at]
                before = used.get(n, 0)
                fit = min(self.count[n] - before, room // n)
                for k in range(fit, 0, -1):
                    grew = True
                    used[n] = before + k
                    search(room - k * n, n - 1, k == fit)
                    used[n] = before
                    if looks <= 0 or 0 in found.values() and len(found) >= most:
                        return
            if not grew and all_fit:
                record(used, room)

        search(self.capacity - largest, largest, True)
        best = sorted(found.items(), key=lambda x: (x[1], len(x[0]), [-n for n, _ in x[0]]))
        kept = [x for k, x in enumerate(best) if not k or not self.dominated(*x)][:most]
        out = []
        for parts, _ in kept:
            out.append((min(self.count[n] // k for n, k in parts), parts))
        return out

    def dominated(self, parts: tuple, waste: int) -> bool:
        """Whether a piece of the filling could give way to a longer one that is left, within the waste."""
        own = dict(parts)
        for n, _ in parts[1:]:
            longer = self.fits(n + waste)
            if longer > n and self.count[longer] > own.get(longer, 0):
                return True
        return False

    def plan(self) -> list[Pattern]:
        best: list[Pattern] | None = None
        most = float("inf")
        path: list[Pattern] = []
        bins = 0
        stack = [iter(self.fillings(4))] if self.lengths else []
        budget = self.nodes
        while stack:
            if not self.lengths and bins < most:
                best, most = list(path), bins
                if most <= self.bound:
                    break
            step = next(stack[-1], None)
            if step is None or (best is not None and budget <= 0):
                stack.pop()
                if not stack or (best is not None and budget <= 0):
                    break
                step = path.pop()
                self.apply(step, 1)
                bins -= step[0]
                continue
            budget -= 1
            after = bins + step[0] - (-(self.left - step[0] * sum(n * k for n, k in step[1])) // self.capacity)
            if after >= most:
                continue
            self.apply(step, -1)
            path.append(step)
            bins += step[0]
            stack.append(iter(self.fillings(4) if self.lengths else ()))
        return best or []


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, which ranks of its pieces go where: sorted by (length, first rank)."""
    rows, sequence, taken = [], 0, {}
    for times, parts in patterns:
        offset = 0
        for n, k in parts:
            first = taken.get(n, 0)
            rows.append((n, first, k, sequence, offset))
            taken[n] = first + times * k
            offset += n * k
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "sequence", "offset"), cols, strict=True))


@lru_cache(2)
def word_ids(path: str) -> WordTable:
    """Ids of pre-tokens by the tokenizers library; kept for all tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(words: list[str]) -> list[list[int]]:
        got = library.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = got.ids
        cuts = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return WordTable(encode)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int) -> DataFrame:
    """The token pieces of every document: its ids and the end id, cut after every `capacity` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, specials = word_ids(vocabulary_path), special_tokens(vocabulary_path)

        def one(batch: pa.RecordBatch) -> dict:
            ids, cuts = encoded(words, batch.column("text"), specials)
            ids = np.insert(ids, cuts[1:], end_id).astype("<u4", copy=False)
            first = cuts[:-1] + np.arange(len(batch))
            size = np.diff(cuts) + 1
            per = -(-size // capacity)
            row = np.repeat(np.arange(len(batch)), per)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            at, raw = 4 * (first[row] + start), memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            return {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        yield from batches(rows, one, schema)

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 4096, end_id: int = 1, share: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds only the end id. Repeated rows are packed each; a null doc_id is kept;
    an empty table gives no rows. A text of any length is cut into pieces of `capacity`. Columns other than doc_id and
    text are not read. Pieces of equal length are
    interchangeable for the plan, so ties cannot change the number of sequences.

    `share`: rows of one length that one task ranks; a commoner length is split over salts.
    """
    cut = shared_table(pieces(docs, vocabulary_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = slots(Planner(counts, capacity).plan())
    salts = -(-max(counts.values(), default=1) // share)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    if salts > 1:
        shares = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        shares = shares.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(shares, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    key = plan["length"] << 44 | plan["first"]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            nth = rank - plan["first"][at]
            copies = plan["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(plan["sequence"][at] + nth // copies), pa.array(plan["offset"][at] + nth % copies * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )
        release()

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
