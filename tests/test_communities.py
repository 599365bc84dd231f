"""Communities by modularity: planted partitions, exact modularity, odd graphs."""

import itertools
import random

from pyspark.sql import functions as F

from draftlake.operators import communities, graph

SCHEMA = "src string, dst string"


def brute_quality(edges, of):
    m = len(edges)
    degree, inside, total = {}, {}, {}
    for a, b in edges:
        for x in (a, b):
            degree[x] = degree.get(x, 0) + 1
        if of[a] == of[b]:
            inside[of[a]] = inside.get(of[a], 0) + 1
    for x, k in degree.items():
        total[of[x]] = total.get(of[x], 0) + k
    return sum(inside.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in total.items())


def planted(rng, groups, size, inner, outer):
    nodes = [(f"g{g}n{k:02d}", g) for g in range(groups) for k in range(size)]
    return [(a, b) for (a, g), (b, h) in itertools.combinations(nodes, 2) if rng.random() < (inner if g == h else outer)]


def test_planted_partitions_are_found(spark):
    edges = planted(random.Random(1), 6, 16, 0.55, 0.02)
    df = spark.createDataFrame(edges, SCHEMA)
    parts = communities.modularity(df)
    of = {r.node: r.community for r in parts.collect()}
    groups = {}
    for node, c in of.items():
        groups.setdefault(c, set()).add(node[:2])
    assert len(groups) == 6 and all(len(g) == 1 for g in groups.values())
    ways = communities.ways_of(df)
    assert abs(communities.quality(ways, parts) - brute_quality(edges, of)) < 1e-9
    spread = graph.label_propagation(df.select("src", F.lit("p").alias("predicate"), "dst"), 4).select("node", F.col("label").alias("community"))
    assert communities.quality(ways, parts) >= communities.quality(ways, spread) - 1e-9


def test_communities_are_connected_and_as_good_as_exhaustive_search(spark):
    rng = random.Random(2)
    for _ in range(2):
        nodes = [f"n{k}" for k in range(8)]
        edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.75 if (a < "n4") == (b < "n4") else 0.1)]
        of = {r.node: r.community for r in communities.modularity(spark.createDataFrame(edges, SCHEMA)).collect()}
        own = sorted(of)
        best = 0.0

        def tried(k, used, part):
            nonlocal best
            if k == len(own):
                best = max(best, brute_quality(edges, part))
                return
            for c in range(used + 1):
                tried(k + 1, max(used, c + 1), part | {own[k]: c})

        tried(0, 0, {})
        assert brute_quality(edges, of) >= 0.95 * best
        for c in set(of.values()):
            left = {n for n in of if of[n] == c}
            front = {min(left)}
            while front:
                left -= front
                front = {b for a, b in edges + [(b, a) for a, b in edges] if a in front and b in left}
            assert not left


def test_odd_graphs(spark):
    assert communities.modularity(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), (None, "x"), ("d", "e"), ("e", "f"), ("f", "d")]
    of = {r.node: r.community for r in communities.modularity(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert of == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d"}
    big = communities.modularity(spark.createDataFrame(rows, SCHEMA), least_members=3).collect()
    assert {r.node for r in big} == {"d", "e", "f"}
