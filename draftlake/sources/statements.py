"""Text files as records in file order, in splits that are read apart, and Part-21 statements made of them.

A record's place is (file, start of its split, place within the split): Spark reads a split in order, but packs splits
into tasks by size, so that a row number alone does not follow the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlake.operators.tables import broadcast_if_small, shared

#: Columns of a record's place, in order.
PLACE = ("path", "block", "at")


def records(spark: SparkSession, path: str, glob: str = "*", separator: str | None = None, *more: Column) -> DataFrame:
    """path, block, at, value: the records of text files, which end with the separator (a line end by default), and what is asked for besides.

    Files of any size are read in splits of spark.sql.files.maxPartitionBytes; within a file (block, at) ascends.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    read = read if separator is None else read.option("lineSep", separator)
    return read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", *more)


def place() -> Column:
    return F.struct(*PLACE)


def statements(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, block, at, nth, value: the statements of Part-21 files, without their semicolon, in file order by (block, at, nth).

    Records end at `);`, as entities do, so that semicolons within strings make no records of their own. A string that
    holds `);` cuts its statement: the piece before has an odd number of quotes, and so has the piece where the string
    ends. These odd pieces, which are few, are paired in file order; the pieces between two of a pair are put together,
    across splits too. All other records stay where they were read, and are cut at the semicolons outside of strings.
    Blank statements are left out; an open string at the end of a file gives the rest of the file as one statement.
    """
    end = ");"
    own = records(spark, path, glob, end, F.col("_metadata.file_size").alias("size"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))
    odd = own.where(quotes % 2 == 1).select(*PLACE)
    turn = Window.partitionBy("path").orderBy("block", "at")
    odd = odd.withColumns({"turn": F.row_number().over(turn), "end": F.lead(F.struct("block", "at")).over(turn)}).where(F.col("turn") % 2 == 1)
    # A string that stays open ends with its file. Places within a split are consecutive, so a span lists its pieces.
    last = F.lit((1 << 63) - 1)
    spans = odd.select("path", F.struct("block", "at").alias("begin"), F.coalesce("end", F.struct(last.alias("block"), last.alias("at"))).alias("end"))
    read = own.groupBy("path", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum(F.octet_length("value") + len(end)).alias("bytes"), F.max("size").alias("size"))
    blocks = shared(read, "blocks")
    met = spans.join(blocks, "path").where(F.col("block").between(F.col("begin.block"), F.col("end.block")))
    low = F.when(F.col("block") == F.col("begin.block"), F.col("begin.at")).otherwise(F.col("first"))
    high = F.when(F.col("block") == F.col("end.block"), F.col("end.at")).otherwise(F.col("last"))
    inside = met.select("path", "block", F.explode(F.sequence(low, high)).alias("at"), "begin", F.lit(False).alias("open"))
    # A file's last record ended without `);` unless the records make up its size, but for a byte order mark.
    ends = blocks.groupBy("path").agg(F.max(F.struct("block", "last")).alias("m"), (F.sum("bytes") - F.max("size")).alias("more")).where(~F.col("more").isin(0, -3))
    ends = ends.select("path", "m.block", F.col("m.last").alias("at"), F.lit(None).cast(inside.schema["begin"].dataType).alias("begin"), F.lit(True).alias("open"))
    marks = shared(inside.unionByName(ends).groupBy(*PLACE).agg(F.max("begin").alias("begin"), F.max("open").alias("open")), "marks")
    met = own.join(broadcast_if_small(marks, 100_000), list(PLACE), "left")
    met = met.withColumn("value", F.concat("value", F.when(F.coalesce("open", F.lit(False)), "").otherwise(")")))
    whole = met.where(F.col("begin").isNull()).select(*PLACE, "value")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    mended = met.where(F.col("begin").isNotNull()).groupBy("path", "begin").agg(F.array_join(pieces, ";").alias("value")).select("path", "begin.block", "begin.at", "value")
    parts = F.when(F.contains("value", F.lit(";")), F.regexp_extract_all("value", F.lit(UNCUT), F.lit(0))).otherwise(F.array("value"))
    out = whole.unionByName(mended).select(*PLACE, F.posexplode(parts).alias("nth", "value"))
    return out.withColumn("value", F.btrim("value", F.lit(" \t\r\n"))).where(F.col("value") != "")


#: A stretch without semicolons but in strings, of which the last may be open.
UNCUT = r"(?:[^';]++|'(?:[^']++|'')*+'?)++"
QUOTED = r"'(?:[^']++|'')*+'"


def argument_pattern(depth: int = 6) -> str:
    """One top-level argument: strings and bracketed lists to a depth are taken whole. Every loop is possessive, so no text is too long."""
    inner = rf"(?:[^()']++|{QUOTED})*+"
    for _ in range(depth - 1):
        inner = rf"(?:[^()']++|{QUOTED}|\({inner}\))*+"
    return rf"(?:[^,()']++|{QUOTED}|\({inner}\))++"


def arguments(statement: Column) -> Column:
    """The top-level arguments of an entity's statement, as they are written."""
    body = F.substring(statement, F.instr(statement, "(") + 1, F.length(statement))
    found = F.regexp_extract_all(F.regexp_replace(body, r"\)\s*\z", ""), F.lit(argument_pattern()), F.lit(0))
    return F.transform(found, lambda a: F.btrim(a, F.lit(" \t\r\n")))


def unquoted(argument: Column) -> Column:
    """The text of a string argument, null for others."""
    return F.when(F.startswith(argument, F.lit("'")), F.replace(F.regexp_replace(argument, r"\A'|'\z", ""), F.lit("''"), F.lit("'")))


def entities(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, id, type, e (the statement) of every entity of Part-21 files; header statements have none."""
    head = r"\A#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\("
    rows = statements(spark, path, glob).where(F.col("value").rlike(head))
    start = F.substring("value", F.lit(1), F.lit(400))  # of the head only
    return rows.select("path", F.regexp_extract(start, head, 1).cast("long").alias("id"), F.upper(F.regexp_extract(start, head, 2)).alias("type"), F.col("value").alias("e"))
