"""Operator 12: spelling variants grouped by letter-parity bitmasks in bands.

The mask of a word has a bit for every class of letters, set where the word holds an odd number of them. One inserted,
deleted or replaced letter flips at most two bits, so of three bands of the mask one stays as it is; and it leaves alone
either the first or the last half of the shorter word. Words meet where a band, that half and the length agree (the
length filter: equal, or one apart). A pair that meets is kept in the first band and half it agrees in, if its masks
differ in at most two bits, and verified by the edit distance itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import shared_table

BANDS, WIDTH = 3, 16
#: Letters by falling frequency in European languages; they are dealt to the bands in turn. Fixed values.
FREQUENT = "esaintrulodcmpghvfbqyjxzkw"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-zÀ-ÿ]+)"


def lower_ascii(run: Column) -> Column:
    """Lower case of A to Z only; a run of single bytes holds no other letters."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def bits() -> list[int]:
    """The bit of each code point below 128: frequent letters have one of their own, other characters share the rest."""
    of = {c: (k % BANDS) * WIDTH + k // BANDS for k, c in enumerate(FREQUENT)}
    return [of.get(chr(c), shared_bit(c)) for c in range(128)]


def shared_bit(point: int | Column) -> int | Column:
    own = -(-len(FREQUENT) // BANDS)
    return point % BANDS * WIDTH + own + point % (WIDTH - own)


def mask(word: Column) -> Column:
    table = F.array(*[F.lit(b) for b in bits()])
    bit = lambda c: F.when(F.ascii(c) < 128, F.get(table, F.ascii(c))).otherwise(shared_bit(F.ascii(c)))  # noqa: E731  ascii: its code point
    flip = lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(c)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(flip(acc, c)))


def words_of(docs: DataFrame, every: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """word and n: how often each word of at least `least` code points occurs, if at least `times`.

    Words are runs of letters with A-Z lower-cased. Where `every` divides h, the unsigned crc32 of `<doc_id>:<run>`, the
    run loses its code point h % length. A null text has no runs, a null doc_id counts as an empty one, repeated rows
    count again, columns other than doc_id and text are not read. Texts are read whole. Occurrences are counted before
    they are shuffled, so that frequent words weigh no more than others.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    own = own.select("id", lower_ascii(F.col("run")).alias("run"))
    own = own.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return own.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def near_pairs(words: DataFrame) -> DataFrame:
    """Each two words (distinct) that differ by exactly one inserted, deleted or replaced code point: a, b, once.

    Here as in what follows both sides of a join grow with the vocabulary, and a small file unfolds to many entries: the
    size that a planner reads off it would have them broadcast, so joins are by sorting.
    """
    own = words.select("word", mask(F.col("word")).alias("mask"), F.char_length("word").alias("size"))
    band = lambda m, k: F.shiftright(m, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")

    def entries(shorter: Column) -> Column:
        """Keys of a word in pairs whose shorter word has that length."""
        first = F.floor(shorter / 2).cast("int")
        halves = [F.substring("word", F.lit(1), first), F.substring("word", F.col("size") - (shorter - first) + 1, shorter - first)]
        key = lambda k, side: F.struct(shorter.alias("shorter"), F.lit(2 * k + side).alias("slot"), band(F.col("mask"), k).alias("band"), halves[side].alias("half"))
        return F.array(*[key(k, side) for k in range(BANDS) for side in range(2)])

    keys = ["shorter", "slot", "band", "half"]
    left = own.select(F.col("word").alias("a"), F.col("mask").alias("x"), F.explode(entries(F.col("size"))).alias("k")).select("a", "x", "k.*")
    both = F.concat(entries(F.col("size")), entries(F.col("size") - 1))
    right = own.select(F.col("word").alias("b"), F.col("mask").alias("y"), "size", F.explode(both).alias("k")).select("b", "y", "size", "k.*")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    earlier = [((F.floor(F.col("slot") / 2) <= k) | (band(differ, k) != 0)) for k in range(BANDS - 1)]
    first = F.floor(F.col("shorter") / 2).cast("int")
    one_half = (F.col("slot") % 2 == 0) | (F.substring("a", F.lit(1), first) != F.substring("b", F.lit(1), first))
    once = (F.col("size") > F.col("shorter")) | (F.col("a") < F.col("b"))
    met = left.hint("merge").join(right, keys).where(once & (F.bit_count(differ) <= 2) & reduce(lambda p, q: p & q, earlier) & one_half)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row word, form: the last word that following the forms reaches. Forms must not be cyclic.

    Each round doubles the way that is followed; a form occurs at least twice as often as its word, so that no way is
    longer than the digits of a count and six rounds are enough for any.
    """
    reached = shared_table(forms.select("word", F.col("form").alias("root")), "variants")
    while not reached.hint("merge").join(reached.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        reached = shared_table(reached.hint("merge").join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "variants")
    return reached


def group(words: DataFrame, factor: int = 2) -> DataFrame:
    """One row for each row word, n: word, form, root, n, n_near, form_n.

    n_near is the number of near words. The form is the near word of the largest n (of equals the first in code-point
    order), if its n is at least `factor` (2 or more) times the word's, else null; root is where following forms ends,
    the word itself without one; form_n is the form's n. Words must be distinct and not null, as words_of() gives them;
    an empty table gives none.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = shared_table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = shared_table(near_pairs(words), "near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counted = both.hint("merge").join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    chosen = words.hint("merge").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    formed = F.col("other_n") >= factor * F.col("n")
    chosen = shared_table(chosen.select("word", F.when(formed, F.col("other")).alias("form"), "n", "n_near", F.when(formed, F.col("other_n")).alias("form_n")), "chosen")
    ends = roots(chosen.where(F.col("form").isNotNull()))
    return chosen.hint("merge").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(every: int = 97, least: int = 5, times: int = 3, factor: int = 2) -> str:
    """The same for DuckDB: near words by patterns with one free place and by deletions, crc32 from its table."""
    return f"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END) AS bytes FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten(bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, table_of),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % {every} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {times}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
patterns AS (SELECT word, n, left(word, i - 1) || '*' || substring(word, i + 1) AS p, left(word, i - 1) || substring(word, i + 1) AS d FROM places),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM patterns a JOIN patterns b ON a.p = b.p AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM patterns a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM patterns a JOIN words b ON a.d = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k FROM near),
chosen AS (
  SELECT w.word, CASE WHEN other_n >= {factor} * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {factor} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
followed AS (
  SELECT word, word AS at, 0 AS steps FROM chosen
  UNION ALL SELECT f.word, c.form, steps + 1 FROM followed f JOIN chosen c ON c.word = f.at WHERE c.form IS NOT NULL)
SELECT c.word, c.form, arg_max(f.at, f.steps) AS root, any_value(c.n) AS n, any_value(c.n_near) AS n_near, any_value(c.form_n) AS form_n
FROM chosen c JOIN followed f ON f.word = c.word GROUP BY c.word, c.form
"""
