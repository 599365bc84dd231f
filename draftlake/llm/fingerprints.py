"""Operator 11: document fingerprints by one-permutation MinHash, with DataFrame functions only.

The distinct 5-word shingles of a text (fewer words: the whole sequence as one) are hashed once. The upper bits of a hash
name its bin, the rest is its value, and each bin keeps its least. An empty bin borrows by optimal densification: bin i
looks at the bins start(i), start(i) + step(i), start(i) + 2 step(i), ... modulo the number of bins, an order of its own
that meets every bin once, and takes the value of the first that is filled. Of every bin's value a few low-order bits are
kept, packed into 64-bit numbers; where they begin differs from bin to bin, so that bins that borrow one and the same
value do not all agree by one chance. Two fingerprints agree in a bin with probability J + (1 - J) / 2**bits, which the likeness
solves for the Jaccard coefficient J.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, BINS, BITS = 5, 512, 4
#: With at least FEW filled bins an empty one looks at so many others in its order; then, or with fewer filled bins, all
#: filled bins are searched for the one that comes first. Both ways find the same bin.
PROBES, FEW = 40, 16
SPACE = " \t\n\x0b\f\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(4)
def orders(bins: int) -> tuple[list[int], list[int], list[int]]:
    """For each bin where its search starts, its odd step, and the step's inverse modulo the number of bins."""
    rng = np.random.default_rng(11)
    start, step = rng.integers(0, bins, bins), rng.integers(0, bins // 2, bins) * 2 + 1
    return start.tolist(), step.tolist(), [pow(s, -1, bins) for s in step.tolist()]


def numbers(values: list[int], kind: str = "int") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One 63-bit hash for every shingle of the text; repeated shingles repeat it."""
    bare = F.btrim(F.lower(text), F.lit(SPACE))
    hashed = let(bare, lambda t: F.transform(F.split(F.when(t != "", t), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    cut = lambda h: h.bitwiseAND(F.lit((1 << 63) - 1))

    def shingled(w: Column) -> Column:
        spans = F.transform(F.slice(w, F.lit(1), F.size(w) - (words - 1)), lambda x, i: cut(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)])))
        return F.when(F.size(w) >= words, spans).when(w.isNotNull(), F.array(cut(F.xxhash64(w)))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, shingled)


def fingerprint(text: Column, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed low-order bits of all bins as an array of longs; empty without words."""
    per, low = 64 // bits, 63 - (bins - 1).bit_length()
    if bins & (bins - 1) or 64 % bits or bins % per:
        raise ValueError("bins and bits must be powers of two that fill whole 64-bit numbers")
    none = (1 << low) - 1
    width = bins.bit_length()
    field = lambda o, k: F.shiftright(o, k * width).bitwiseAND(F.lit((1 << width) - 1))
    shifts = [bits * (i % (low // bits)) for i in range(bins)]
    order = numbers([sum(v << k * width for k, v in enumerate(x)) for x in zip(*orders(bins), shifts, strict=True)], "bigint")
    value = lambda x: x.bitwiseAND(F.lit(none))
    bin_of = lambda x: F.shiftright(x, low)
    within = lambda x: x.bitwiseAND(F.lit(bins - 1))
    # one last value for each bin marks it: after sorting every bin begins with its least hash or, if empty, its mark
    marks = numbers([b << low | none for b in range(bins)], "bigint")

    def filled_up(least: Column) -> Column:
        dense = F.transform(least, lambda x: F.nullif(value(x), F.lit(none)))
        filled = F.filter(least, lambda x: value(x) != none)

        def first(some: Column, o: Column) -> Column:
            """The filled bin that comes first in the order o: its place in the order stands above its value."""
            place = lambda x: within((bin_of(x) - field(o, 0)) * field(o, 2))
            return value(F.array_min(F.transform(some, lambda x: F.shiftleft(place(x), low).bitwiseOR(value(x)))))

        probed = lambda d, o: F.coalesce(*[F.get(d, within(field(o, 0) + t * field(o, 1)).cast("int")) for t in range(PROBES)])
        borrowed = lambda d, some, o: F.coalesce(F.when(F.size(some) >= FEW, probed(d, o)), first(some, o))
        kept = lambda x, o: F.call_function("shiftright", x, field(o, 3).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))
        return let(dense, lambda d: let(filled, lambda some: F.zip_with(d, order, lambda x, o: kept(F.coalesce(x, borrowed(d, some, o)), o))))

    def packed(full: Column) -> Column:
        one = lambda j: F.aggregate(F.slice(full, j * per + 1, F.lit(per)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, bits).bitwiseOR(x))
        return F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), one)

    def binned(hashes: Column) -> Column:
        least = let(F.sort_array(F.concat(hashes, marks)), lambda a: F.filter(a, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(a, i - 1)))))
        return F.when(F.size(hashes) == 0, F.slice(hashes, 1, 0)).otherwise(let(let(least, filled_up), packed))

    return let(shingle_hashes(F.coalesce(text, F.lit("")), words), binned)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Jaccard coefficient of the texts of two fingerprints, from 0 to 1; two without words are alike, one is not."""
    ones = int("".join(["0" * (bits - 1) + "1"] * (64 // bits)), 2)

    def unequal(x: Column, y: Column) -> Column:
        """Fields of two numbers that differ: all bits of a field are gathered in its lowest."""
        d = x.bitwiseXOR(y)
        gathered = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(d, k) for k in range(1, bits)], d)
        return F.bit_count(gathered.bitwiseAND(F.lit(ones)))

    apart = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << bits)
    solved = F.greatest(F.lit(0.0), ((bins - apart) / float(bins) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(solved)


def text_of(packed: Column) -> Column:
    """The numbers of a fingerprint in lowercase hexadecimal, one after the other."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, text and fingerprint (array of longs) of every row.

    A null text counts as empty and has an empty fingerprint; a null doc_id is kept; repeated rows repeat; an empty
    table gives none. Texts are read whole, whatever their length; of equal hashes in a bin it does not matter which is
    kept. Columns other than doc_id and text are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("fingerprint", fingerprint(F.col("text"), words, bins, bits))


def bounds_of(ids: DataFrame, parts: int) -> list[int]:
    """At most `parts` values of doc_id, the least among them, that cut its order into portions of about one size."""
    found = ids.where(F.col("doc_id").isNotNull()).agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()
    return [] if found[0] is None else sorted({found[0], *(found[1] if parts > 1 else [])})


def with_next(df: DataFrame, parts: int) -> DataFrame:
    """Each row with `next_text` and `next_fingerprint` of the row after it, by ascending doc_id and then text.

    After the last row comes the first. Rows are dealt by portions of doc_id, and the first of each portion also goes,
    once more, to the end of the portion before: one shuffle of the texts, and no sort of all rows in one task. A row
    without doc_id has no place in the order; the first row counts as its next. Without any doc_id next is null.
    """
    bounds = bounds_of(df, parts)
    if not bounds:
        return df.withColumns({"next_text": F.lit(None).cast("string"), "next_fingerprint": F.lit(None).cast("array<bigint>")})
    width = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    heads, block = numbers([b[0] for b in blocks], "bigint"), F.array(*[numbers(b, "bigint") for b in blocks])
    not_above = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
    portion = let(not_above(heads) - 1, lambda k: k * width + not_above(F.get(block, k)) - 1)
    known = df.where(F.col("doc_id").isNotNull()).withColumns({"portion": portion, "again": F.lit(False)})
    firsts = df.where(F.col("doc_id").isin(bounds)).groupBy("doc_id").agg(F.min(F.struct("text", "fingerprint")).alias("f"))
    before = F.pmod(F.array_position(numbers(bounds, "bigint"), F.col("doc_id")) - 2, F.lit(len(bounds))).cast("int")
    again = firsts.select("doc_id", "f.text", "f.fingerprint", before.alias("portion"), F.lit(True).alias("again"))
    order = Window.partitionBy("portion").orderBy("again", "doc_id", "text")
    follow = {"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}
    ordered = known.unionByName(again).withColumns(follow).where(~F.col("again")).drop("portion", "again")
    first = firsts.where(F.col("doc_id") == bounds[0]).select(F.lit(True).alias("lost"), F.col("f.text").alias("next_text"), F.col("f.fingerprint").alias("next_fingerprint"))
    # one row of one text is sent to the rows without doc_id
    lost = df.where(F.col("doc_id").isNull()).withColumn("lost", F.lit(True)).join(F.broadcast(first), "lost", "left").drop("lost")
    return ordered.unionByName(lost)


def edited(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likeness of each pair.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text, see with_next. doc_id, text, edited_text, n_chars, fingerprint, edited_fingerprint (arrays),
    near_edited, near_next. Odd rows are treated as by fingerprints() and with_next(); where there is no next document
    it counts as empty.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = with_next(fingerprints(docs, words, bins, bits), parts).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    made = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = both.withColumn("edited_text", made).withColumn("edited_fingerprint", fingerprint(F.col("edited_text"), words, bins, bits))
    empty = F.array().cast("array<bigint>")
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, bits), "near_next": likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", empty), bins, bits)}
    return both.withColumns(near).drop("next_text", "next_fingerprint")
