"""The driver's star schema seen as drawings: one SQL text for Spark and for the oracle.

orders are drawings, lineitems their elements, customers' nations the projects, parts the section catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "objects": """SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_orderkey AS document_id, concat('P', cast(l_suppkey % 7 AS string)) AS project_id,
  CASE l_returnflag WHEN 'A' THEN 'Door' WHEN 'N' THEN 'Window' ELSE 'Wall' END AS kind, concat('A-', l_linestatus, '-', cast(l_suppkey % 5 AS string)) AS layer,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('B', cast(l_partkey % 25 AS string)) END AS block, CASE WHEN l_discount > 0.05 THEN 'AI_INFERRED' ELSE 'OBSERVED' END AS state,
  CASE WHEN l_linenumber <= 4 THEN concat(cast(l_linenumber AS string), 'F') ELSE '' END AS storey, CASE WHEN l_quantity < 10 THEN 'plan' WHEN l_quantity < 30 THEN 'section' ELSE 'detail' END AS category,
  concat('L', cast(l_linenumber % 2 AS string)) AS layout, concat('item ', cast(l_partkey AS string)) AS label, 1.0 - l_discount * 2 AS confidence, l_linenumber AS n, l_shipdate AS ts,
  cast(l_partkey % 500 AS double) AS min_x, cast(l_suppkey % 97 AS double) * 5 AS min_y, cast(l_partkey % 500 AS double) + l_quantity AS max_x, cast(l_suppkey % 97 AS double) * 5 + l_quantity AS max_y FROM {lineitem}""",
    "drawings": """SELECT o_orderkey AS document_id, concat('P', cast(o_custkey % 50 AS string)) AS project_key, o_custkey, concat('A-', cast(100 + o_orderkey % 900 AS string)) AS number,
  concat('plan x', cast(o_custkey AS string), '_', substr(cast(o_orderdate AS string), 6, 2), substr(cast(o_orderdate AS string), 9, 2), '.dwg') AS name, o_orderdate AS modified,
  CASE WHEN o_orderstatus = 'O' THEN 'plan' ELSE 'detail' END AS category, CASE o_orderpriority WHEN '1-URGENT' THEN 'ARCH' WHEN '2-HIGH' THEN 'STRUCT' WHEN '5-LOW' THEN NULL ELSE 'MECH' END AS discipline, o_totalprice FROM {orders}""",
    "frames": """SELECT p_partkey AS id, cast(p_partkey % 40 AS double) * 25 AS min_x, cast(p_partkey % 23 AS double) * 40 AS min_y, cast(p_partkey % 40 AS double) * 25 + p_size * 2 AS max_x, cast(p_partkey % 23 AS double) * 40 + p_size AS max_y FROM {part}""",
    "marks": """SELECT s_suppkey AS id, cast(s_suppkey % 31 AS double) * 30 AS min_x, cast(s_suppkey % 19 AS double) * 45 AS min_y, cast(s_suppkey % 31 AS double) * 30 + 6 AS max_x, cast(s_suppkey % 19 AS double) * 45 + 4 AS max_y FROM {supplier}""",
    "edges": """SELECT concat('r', cast(n_regionkey AS string)) AS src, 'hasNation' AS predicate, concat('n', cast(n_nationkey AS string)) AS dst FROM {nation}
  UNION ALL SELECT concat('n', cast(s_nationkey AS string)), 'hasSupplier', concat('s', cast(s_suppkey AS string)) FROM {supplier}
  UNION ALL SELECT concat('n', cast(c_nationkey AS string)), 'hasCustomer', concat('c', cast(c_custkey AS string)) FROM {customer}""",
    "nodes": """SELECT concat('r', cast(r_regionkey AS string)) AS id, 'Region' AS type, r_name AS name FROM {region} UNION ALL SELECT concat('n', cast(n_nationkey AS string)), 'Nation', n_name FROM {nation}
  UNION ALL SELECT concat('s', cast(s_suppkey AS string)), 'Supplier', s_name FROM {supplier} UNION ALL SELECT concat('c', cast(c_custkey AS string)), 'Customer', c_name FROM {customer}""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, or a view of VIEWS over them; parquet scans that projections and filters reach."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(text, **{t: table(spark, sf, t) for t in used})


def oracle(body: str) -> str:
    """DuckDB SQL: the views that the body names come first."""
    used = [v for v in VIEWS if f"{{{v}}}" in body]
    views = ", ".join(f"v_{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used)
    text = body.format(**{v: f"v_{v}" for v in VIEWS})
    if not used:
        return text
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return f"{head}{views}, {text.removeprefix(head)}"
    return f"WITH {views} {text}"


@dataclass
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function of (table reader, spark) under its own name; sql is the oracle's body."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: table(spark, sf_dir, name), spark)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = Query(fn.__name__, operators, run, oracle(sql) if sql else None)
        return fn

    return add
