"""Nested blocks: transforms, cycles, depth, effective counts."""

import math

from draftlake.operators import blocks

INSERT = "document int, id int, owner string, block string, x double, y double, sx double, sy double, rotation double"
TEXT = "document int, owner string, text string, x double, y double"
NAMES = "document int, block string, source string"


def test_texts_in_world_coordinates(spark):
    rows = [
        (1, 1, None, "A", 10.0, 0.0, 2.0, 2.0, 90.0), (1, 2, "A", "B", 1.0, 1.0, None, -1.0, None), (1, 3, "B", "A", 0.0, 0.0, 1.0, 1.0, 0.0),
        (1, 4, "C", "B", 0.0, 0.0, 1.0, 1.0, 0.0), (2, 1, None, "B", 5.0, 5.0, 1.0, 1.0, 180.0), (1, 5, None, None, 0.0, 0.0, 1.0, 1.0, 0.0),
    ]
    texts = [(1, None, "free", 3.0, 4.0), (1, "B", "deep", 2.0, 3.0), (2, "B", "other", 1.0, 0.0), (1, "C", "never", 0.0, 0.0)]
    out = blocks.texts_in_world(spark.createDataFrame(texts, TEXT), blocks.inserts_of(spark.createDataFrame(rows, INSERT))).collect()
    got = {(r.document, r.root, r.text): (round(r.x, 6), round(r.y, 6), r.depth) for r in out}
    # in A at (1 + 2, 1 - 3) = (3, -2); twice as large, a quarter turn, moved by (10, 0)
    assert got == {(1, None, "free"): (3.0, 4.0, 0), (1, 1, "deep"): (14.0, 6.0, 2), (2, 1, "other"): (4.0, 5.0, 1)} and len(out) == 3


def test_depth_and_counts(spark):
    chain = [(1, k, None if k == 0 else f"b{k - 1}", f"b{k}", 0.0, 0.0, 1.0, 1.0, 0.0) for k in range(12) for _ in range(2)]
    made = spark.createDataFrame(chain, INSERT)
    assert {r.block: r.effective for r in blocks.insert_counts(made, spark.createDataFrame([], NAMES)).collect()} == {f"b{k}": 2 ** (k + 1) if k < 8 else 0 for k in range(12)}
    assert blocks.placements(blocks.inserts_of(made)).count() == sum(2**k for k in range(1, 9))
    anonymous = [(1, 1, None, "*U1", 0.0, 0.0, 1.0, 1.0, 0.0), (1, 2, None, "*U2", 0.0, 0.0, 1.0, 1.0, 0.0), (1, 3, "*U1", "Leaf", 0.0, 0.0, 1.0, 1.0, 0.0), (1, 4, "Loop", "Loop", 0.0, 0.0, 1.0, 1.0, 0.0)]
    names = spark.createDataFrame([(1, "*U1", "Door"), (1, "*U2", "Door"), (2, "Leaf", "x")], NAMES)
    got = {r.block: (r.inserts, r.effective, r.deepest) for r in blocks.insert_counts(spark.createDataFrame(anonymous, INSERT), names).collect()}
    assert got == {"Door": (2, 2, 1), "Leaf": (1, 2, 2), "Loop": (1, 0, None)}
    assert blocks.placements(blocks.inserts_of(spark.createDataFrame([], INSERT))).count() == 0


def test_composition_is_that_of_matrices(spark):
    from pyspark.sql import functions as F

    lit = lambda *v: blocks.matrix(*[F.lit(float(x)) for x in v])
    m = spark.range(1).select(blocks.composed(lit(1, 2, 3, 4, 30), lit(5, 6, 0.5, 2, -75)).alias("m")).first().m
    turn = lambda x, y, sx, sy, r, p: (x + sx * p[0] * math.cos(math.radians(r)) - sy * p[1] * math.sin(math.radians(r)), y + sx * p[0] * math.sin(math.radians(r)) + sy * p[1] * math.cos(math.radians(r)))
    want = turn(1, 2, 3, 4, 30, turn(5, 6, 0.5, 2, -75, (7, -3)))
    assert math.isclose(m.a * 7 + m.c * -3 + m.e, want[0]) and math.isclose(m.b * 7 + m.d * -3 + m.f, want[1])
