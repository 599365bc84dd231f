"""Operator 9: line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines, each hashed without the white space around it. A window is a shortest
stretch of lines with at least `min_words` words, taken forward from each line and backward from each line, so that
every run of that many words is a chain of windows. Each window selects its smallest line hash (the rightmost of equals)
as fingerprint: copies of a run select the same ones. Fingerprints that occur at one place only are dropped. At the
others positions are joined: those whose windows agree, each with the earliest, by (doc_id, line). A match is extended
both ways along its diagonal, from window to window of the same source, to a run; the run's lines are then compared
with the source's, byte by byte, and only equal ones go. Nothing is deleted on the word of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import byte_hashes, chunks, release, shared_table, small_batches, span_hashes, utf8

BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BLANKS = " \t\x0b\x0c\r"
#: Stretches up to which the requests for them are broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 200_000
WINDOW = "fp long, window long, doc long, digest long, first int, last int, place int, chosen boolean"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-blank lines of all texts: owner, number among its text's non-blank lines, and the trimmed span."""
    n = np.diff(offsets)
    ends = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(ends, offsets)) + (n > 0)
    some = n > 0
    starts = np.sort(np.concatenate([offsets[:-1][some], ends + 1]), kind="stable")
    stops = np.sort(np.concatenate([ends, offsets[1:][some]]), kind="stable")
    owner = np.repeat(np.arange(len(n)), per)
    ink = np.append(np.flatnonzero(~BLANK[data]), len(data))
    a = np.searchsorted(ink, starts)
    b = np.searchsorted(ink, stops)
    full = b > a
    owner = owner[full]
    return owner, np.arange(len(owner)) - np.searchsorted(owner, owner, "left"), ink[a[full]], ink[b[full] - 1] + 1


def windows(data: np.ndarray, offsets: np.ndarray, min_words: int) -> dict[str, np.ndarray] | None:
    owner, number, starts, stops = line_spans(data, offsets)
    if not len(owner):
        return None
    space = BLANK[data]
    begin = ~space
    begin[1:] &= space[:-1]
    begin[starts] = True
    before = np.concatenate([[0], np.cumsum(begin)])
    words = np.concatenate([[0], np.cumsum(before[stops] - before[starts])])
    own = byte_hashes(data, starts, stops)
    n = len(owner)
    place = np.arange(n)
    first_of = np.searchsorted(owner, owner, "left")
    after = np.searchsorted(owner, owner, "right")
    last = np.searchsorted(words, words[:-1] + min_words, "left") - 1  # forward from each line
    ahead = last < after
    first = np.searchsorted(words, words[1:] - min_words, "right") - 1  # backward from each line
    back = first >= first_of
    both = np.unique(np.concatenate([place[ahead] * n + last[ahead], first[back] * n + place[back]]))
    first, last = both // n, both % n
    if not len(first):
        return None
    low, at = own[first].copy(), first.copy()
    live = np.flatnonzero(last > first)
    step = 1
    while len(live):
        here = first[live] + step
        less = own[here] <= low[live]
        low[live[less]], at[live[less]] = own[here[less]], here[less]
        step += 1
        live = live[first[live] + step <= last[live]]
    chosen = np.zeros(len(at), bool)
    chosen[np.unique(at, return_index=True)[1]] = True
    return {
        "fp": low.view(np.int64), "window": span_hashes(own, first, last + 1).view(np.int64), "row": owner[first],
        "first": number[first].astype(np.int32), "last": number[last].astype(np.int32), "place": number[at].astype(np.int32), "chosen": chosen,
    }


def keyed(docs: DataFrame) -> DataFrame:
    """doc and digest tell rows apart; a null doc_id stands before all others."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "digest": F.xxhash64(F.col("text").cast("string"))})


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Windows that repeat an earlier one: doc, digest, first and last line, and the earliest place of the same lines.

    Lines are numbered from 0 among the non-blank ones.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                found = windows(*utf8(part.column("text")), min_words)
                if found is None:
                    continue
                who = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["fp"]), pa.array(found["window"]), part.column("doc").take(who), part.column("digest").take(who), *(pa.array(found[k]) for k in ("first", "last", "place", "chosen"))],
                    names=["fp", "window", "doc", "digest", "first", "last", "place", "chosen"],
                )
        release()

    source = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc", "digest", "text")
    made = shared_table(source.mapInArrow(run, WINDOW), "windows")
    spot = F.struct("doc", "digest", "place")
    shared = made.where("chosen").groupBy("fp").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a != b").select("fp")
    near = made.join(shared, "fp").select("window", "doc", "digest", "first", "last")
    spot = F.struct("doc", "digest", "first", "last")
    source = near.groupBy("window").agg(F.min(spot).alias("source"), F.max(spot).alias("latest")).where("source != latest").select("window", "source")
    return near.join(source, "window").where(F.struct("doc", "digest", "first", "last") > F.col("source")).select("doc", "digest", "first", "last", "source")


RUN = "doc long, digest long, first int, last int, sdoc long, sdigest long, sfirst int, slast int"


def runs(found: DataFrame) -> DataFrame:
    """Matches extended along their diagonals: runs of lines, first to last, and where the source has them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            every = batch.column("found")
            flat = every.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(every.offsets.to_numpy()))
            first, last = (flat.field(k).to_numpy() for k in (0, 1))
            sdoc, sdigest, sfirst, slast = (flat.field(2).field(k).to_numpy() for k in range(4))
            order = np.lexsort((last, first, first - sfirst, sdigest, sdoc, row))
            row, first, last, sdoc, sdigest, sfirst, slast = (x[order] for x in (row, first, last, sdoc, sdigest, sfirst, slast))
            same = (row[1:] == row[:-1]) & (sdoc[1:] == sdoc[:-1]) & (sdigest[1:] == sdigest[:-1]) & (first[1:] - sfirst[1:] == first[:-1] - sfirst[:-1])
            same &= first[1:] <= last[:-1] + 1
            at = np.flatnonzero(np.concatenate([[True], ~same]))
            end = np.maximum.reduceat(last, at)
            who = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(who), batch.column("digest").take(who), pa.array(first[at]), pa.array(end), pa.array(sdoc[at]), pa.array(sdigest[at]), pa.array(sfirst[at]), pa.array(end - first[at] + sfirst[at])],
                names=[x.split()[0] for x in RUN.split(", ")],
            )
        release()

    gathered = found.groupBy("doc", "digest").agg(F.collect_set(F.struct("first", "last", "source")).alias("found"))
    return gathered.mapInArrow(run, RUN)


def inked(text: str) -> tuple[list[int], list[str]]:
    """Places and trimmed forms of the non-blank lines."""
    trimmed = [x.strip(BLANKS) for x in text.split("\n")]
    places = [k for k, x in enumerate(trimmed) if x]
    return places, [trimmed[k] for k in places]


def stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of every stretch of a source that some run repeats: sdoc, sdigest, sfirst, slast, body."""
    asked = found.groupBy(F.col("sdoc").alias("doc"), F.col("sdigest").alias("digest")).agg(F.collect_set(F.struct("sfirst", "slast")).alias("asked"))
    few = (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(asked) if few else asked, ["doc", "digest"]).dropDuplicates(["doc", "digest"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for doc, digest, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "digest", "text", "asked")), strict=True):
                _, lines = inked(text)
                out += [(doc, digest, s["sfirst"], s["slast"], "\n".join(lines[s["sfirst"] : s["slast"] + 1])) for s in asked]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["sdoc", "sdigest", "sfirst", "slast", "body"])
        release()

    return texts.select("doc", "digest", "text", "asked").mapInArrow(run, "sdoc long, sdigest long, sfirst int, slast int, body string")


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All rows and columns of docs with text less its repeated runs, and n_lines and n_deleted.

    A line goes if it lies in a stretch of consecutive non-blank lines with at least min_words words whose lines stand
    in the same order at an earlier place: in a document with a smaller doc_id, or earlier in the same one. Line by
    line, exactly: the first copy stays. Blank lines stay. Rows that share a doc_id are told apart by their text;
    identical rows are one document and get the same result. A null doc_id comes first. A null text stays null, an
    empty one empty, both with 0 lines; an empty table gives none. Texts of any length are read whole. Columns n_lines
    and n_deleted of docs are replaced.
    """
    found = shared_table(runs(repeats(docs, min_words)), "runs")
    source = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc", "digest", "text")
    compared = found.join(stretches(source, found), ["sdoc", "sdigest", "sfirst", "slast"])
    spans = compared.groupBy("doc", "digest").agg(F.collect_list(F.struct("first", "last", "body")).alias("spans"))
    plain = docs.drop("n_lines", "n_deleted")
    names = plain.columns
    rest = [F.col(c) for c in names if c != "text"]
    own = keyed(small_batches(plain).select(F.struct(*rest).alias("kept"), "doc_id", F.col("text").cast("string").alias("text")))
    joined = own.join(spans, ["doc", "digest"], "left").select("kept", "text", "spans")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, lines, gone = [], [], []
            for text, spans_of in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if not spans_of:
                    texts.append(text)
                    lines.append(text.count("\n") + 1 if text else 0)
                    gone.append(0)
                    continue
                own, (places, trimmed) = text.split("\n"), inked(text)
                drop: set[int] = set()
                for s in spans_of:
                    a, b = s["first"], s["last"] + 1
                    if "\n".join(trimmed[a:b]) == s["body"]:
                        drop.update(places[a:b])
                texts.append("\n".join([x for k, x in enumerate(own) if k not in drop]))
                lines.append(len(own))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["kept", "text", "n_lines", "n_deleted"])
        release()

    out = joined.mapInArrow(run, f"kept {joined.schema['kept'].dataType.simpleString()}, text string, n_lines long, n_deleted long")
    return out.select(*[F.col("text") if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in names], "n_lines", "n_deleted")
