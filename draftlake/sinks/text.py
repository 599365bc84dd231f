"""One row of text for each node, edge or entity; write with write_lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(value: Column) -> Column:
    """A double-quoted literal for Turtle and Cypher."""
    own = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(own, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def sql_literal(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def xml_text(value: Column) -> Column:
    own = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(own, F.lit('"'), F.lit("&quot;"))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def turtle(triples: DataFrame) -> DataFrame:
    """Rows (s, p, o, literal) as Turtle statements."""
    value = F.when(F.col("literal"), quoted(F.col("o"))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), value, F.lit(" .")).alias("line"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """Rows (id, type, name) as MERGE statements."""
    return nodes.select(F.concat(F.lit("MERGE (n:"), F.col("type"), F.lit(" {id: "), quoted(F.col("id")), F.lit("}) SET n.name = "), quoted(F.col("name")), F.lit(";")).alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    match = F.concat(F.lit("MATCH (a {id: "), quoted(F.col("src")), F.lit("}), (b {id: "), quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.col("predicate"), F.lit("]->(b);"))
    return edges.select(match.alias("line"))


def jsonld_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), F.col("name").alias("name"))).alias("line"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered lines of a GraphML document: place, line."""
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="type">'), xml_text(F.col("type")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"><data key="predicate">'), xml_text(F.col("predicate")), F.lit("</data></edge>")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, '<graphml><key id="type" for="node"/><key id="predicate" for="edge"/><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def svg_lines(entities: DataFrame) -> DataFrame:
    """Preview element of each entity: line, polyline or circle."""
    at = lambda k, a: F.round(F.col("points")[k][a], 3).cast("string")
    circle = F.concat(F.lit('<circle cx="'), at(0, 0), F.lit('" cy="'), at(0, 1), F.lit('" r="'), F.round("radius", 3).cast("string"), F.lit('"/>'))
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(",", F.round(p[0], 3).cast("string"), F.round(p[1], 3).cast("string"))), " ")
    shape = F.when(F.col("entity_type").isin("CIRCLE", "ARC"), circle).otherwise(F.concat(F.lit('<polyline points="'), points, F.lit('"/>')))
    return entities.where(F.size("points") > 0).select("path", shape.alias("line"))


def markdown(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Table lines of a pivoted count matrix."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(group).cast("string"), *cells), F.lit(" |")).alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines as text files, sorted within each; give an order for ranges that follow one another."""
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    out.select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """JSON lines, CSV or Parquet, partitioned by columns."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    {"json": writer.json, "csv": lambda p: writer.option("header", "true").csv(p), "parquet": writer.parquet}[kind](path)
