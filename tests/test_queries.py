"""Every registered query against its oracle on the smallest driver tables."""

import datetime
import math
import os

import duckdb
import pytest

from draftlake.plans import catalog, contracts, graph, questions, readers, text  # noqa: F401
from draftlake.plans.adapters import QUERIES, TABLES

DATA = os.environ.get("DRAFTLAKE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, DATA)
    rows = df.collect()
    if q.sql is None:
        assert rows
        return
    got = duck.execute(q.sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    own = sorted(columns)
    want = sorted(tuple(shown(r[columns.index(c)]) for c in own) for r in got.fetchall())
    assert sorted(tuple(shown(r[c]) for c in own) for r in rows) == want


def test_every_query_names_its_operators():
    assert all(q.operators for q in QUERIES.values())


def test_queries_without_sql_read_every_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert QUERIES["hash_vector1024"].run(spark, DATA).count() == docs.count()
    assert max(r.id for r in QUERIES["wall_face_pairs"].run(spark, DATA).collect() if r.id < 1_000_000) >= 23


def test_area_labels_of_late_frames(spark, tmp_path):
    spark.createDataFrame([(920, 5)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [tuple(r) for r in QUERIES["greedy_area_labels"].run(spark, str(tmp_path)).collect()] == [(920, 1, 10.0)]


def test_citations_of_ids_that_documents_share(spark, tmp_path):
    """Part keys beyond 100,000 give lines of two orders the same id: each order still cites a line of its own."""
    day = datetime.datetime(2020, 1, 2)
    items = [(1, 6, 500005, 1, "A", "O", 5.0, 0.0, day), (1, 3, 9, 1, "A", "O", 5.0, 0.0, day), (2, 1, 5, 1, "A", "O", 5.0, 0.0, day)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 1, "O", 1.0, day, "5-LOW") for k in (1, 2)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    assert {(r.cid, r.object_id) for r in QUERIES["ask_citations"].run(spark, str(tmp_path)).collect()} == {(1, 1300009), (2, 2100005)}
