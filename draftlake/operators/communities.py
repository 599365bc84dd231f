"""Communities of a graph by modularity: rounds of local moves, refinement to connected parts, contraction.

A round is two equi-joins: the ways of every node with the communities of their ends, and what that gives with the
communities' degrees. Nodes that move at the same time could swap places for ever, so each round colours the
communities by a hash: nodes of one colour may move to communities of the other. All tables stay in Spark; the driver
sees the modularity and the number of moves of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators.tables import shared


def ways_of(edges: DataFrame) -> DataFrame:
    """node, other, w in both directions, parallel edges added; a loop counts twice at its node."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    own = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", weight.alias("w"))
    both = own.select(F.col("src").alias("node"), F.col("dst").alias("other"), "w").unionByName(own.select(F.col("dst").alias("node"), F.col("src").alias("other"), "w"))
    return both.groupBy("node", "other").agg(F.sum("w").alias("w"))


def quality(ways: DataFrame, parts: DataFrame) -> float:
    """Modularity of a partition (node, community) of a graph's ways."""
    whole = ways.agg(F.sum("w")).first()[0] or 1.0
    ends = ways.join(parts.select("node", F.col("community").alias("a")), "node").join(parts.select(F.col("node").alias("other"), F.col("community").alias("b")), "other")
    rows = ends.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    return rows.agg(F.sum(F.col("inside") / whole - (F.col("total") / whole) ** 2)).first()[0] or 0.0


def moved(ways: DataFrame, state: DataFrame, whole: float, turn: int) -> DataFrame:
    """node, k, community after one round, with the community before, the weight of the ways inside it, and whether
    the node would gain by some move, of any colour."""
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    toward = ways.where("node != other").join(state.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("w").alias("w"))
    options = toward.join(totals, "community").join(state.join(totals, "community").select("node", "k", F.col("community").alias("own"), F.col("total").alias("own_total")), "node")
    colour = lambda c: F.pmod(F.xxhash64(c, F.lit(turn // 2)), F.lit(2))
    may = (colour("own") == turn % 2) & (colour("community") != turn % 2)
    # the gain of a move is this, less the weight of the ways into the own community, times 2 / whole
    gain = F.col("w") - F.col("k") * (F.col("total") - F.col("own_total") + F.col("k")) / whole
    best = F.min(F.when(may, F.struct((-gain).alias("less"), F.col("community").alias("to")))).alias("best")
    most = F.max(F.when(F.col("community") != F.col("own"), gain)).alias("most")
    chosen = options.groupBy("node").agg(F.sum(F.when(F.col("community") == F.col("own"), F.col("w")).otherwise(0.0)).alias("inside"), best, most)
    out = state.join(chosen, "node", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    gains = lambda g: F.coalesce(g - F.col("inside") > 1e-12 * whole, F.lit(False))
    after = F.when(gains(-F.col("best.less")), F.col("best.to")).otherwise(F.col("community"))
    return out.select("node", "k", after.alias("community"), F.col("community").alias("before"), "inside", gains(F.col("most")).alias("wishes"))


def local_moves(ways: DataFrame, state: DataFrame, least_gain: float, patience: int) -> tuple[DataFrame, float]:
    """The best partition that rounds of moves from this one reach, and its modularity.

    Ends when no node would gain by a move, or after `patience` rounds whose moves have gained nothing together.
    """
    whole, loops = ways.agg(F.sum("w"), F.sum(F.when(F.col("node") == F.col("other"), F.col("w")))).first()
    best, most, idle, turn, wishes, before = state, -1.0, 0, 0, 1, 0
    while idle < patience and wishes:
        after = shared(moved(ways, state, whole, turn), "moves")
        inside, moves, wishes = after.agg(F.sum("inside"), F.count_if(F.col("community") != F.col("before")), F.count_if("wishes")).first()
        spread = state.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / whole) ** 2)).first()[0]
        now = (inside + (loops or 0.0)) / whole - spread
        idle += before > 0 and now <= most + least_gain
        if now > most + least_gain:
            best, most, idle = state, now, 0
        state, turn, before = after.select("node", "k", "community"), turn + 1, moves
    return best, most


def connected_parts(ways: DataFrame, state: DataFrame) -> DataFrame:
    """node, part: the connected pieces of each community, by the least node of each; rounds halve the ways between labels."""
    own = state.select("node", "community")
    inner = ways.where("node != other").join(own, "node").join(own.select(F.col("node").alias("other"), F.col("community").alias("c")), "other").where("community = c")
    inner = shared(inner.select("node", "other"), "inner")
    labels = shared(own.select("node", F.col("node").alias("part")), "parts")
    while True:
        seen = inner.join(labels.select(F.col("node").alias("other"), F.col("part").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        least = labels.join(seen, "node", "left").select("node", "part", F.least("part", F.coalesce("seen", "part")).alias("to"))
        onward = labels.select(F.col("node").alias("to"), F.col("part").alias("onward"))
        after = shared(least.join(onward, "to", "left").select("node", F.least("to", F.coalesce("onward", "to")).alias("part"), F.col("part").alias("before")), "parts")
        labels = after.select("node", "part")
        if after.where("part != before").isEmpty():
            return labels


def modularity(edges: DataFrame, least_gain: float = 1e-6, patience: int = 6, least_members: int = 1) -> DataFrame:
    """node, community of every node of edges (src, dst, and weight where there is one), by modularity.

    Levels of local moves; each level's communities are refined to connected parts, which become the nodes of the next
    level's graph and start there in their community. Ends when a level gains no more than `least_gain`. A community is
    named by its least member; those of fewer than `least_members` are left out. Edges with a null end do not count, an
    empty table gives none. The result depends on nothing but the edges.
    """
    ways = shared(ways_of(edges), "ways")
    names = ways.select("node").distinct().select("node", F.col("node").alias("at"))  # each node's place in the level's graph
    start = ways.groupBy("node").agg(F.sum("w").alias("k")).withColumn("community", F.col("node"))
    state, reached = shared(start, "state"), None
    if state.isEmpty():
        return state.select("node", "community")
    while True:
        state, now = local_moves(ways, state, least_gain, patience)
        parts = connected_parts(ways, state)
        # a community in two pieces has no ways between them: parting it never lowers modularity
        place = parts.select(F.col("node").alias("at"), "part")
        names = shared(names.join(place, "at").select("node", F.col("part").alias("at")), "names")
        grouped = state.join(parts, "node").groupBy("part").agg(F.sum("k").alias("k"), F.min("community").alias("community"))
        if reached is not None and now <= reached + least_gain:
            break
        reached = now
        named = parts.select("node", "part")
        joined = ways.join(named, "node").join(named.select(F.col("node").alias("other"), F.col("part").alias("q")), "other")
        ways = shared(joined.groupBy(F.col("part").alias("node"), F.col("q").alias("other")).agg(F.sum("w").alias("w")), "ways")
        state = shared(grouped.select(F.col("part").alias("node"), "k", "community"), "state")
    out = names.groupBy("at").agg(F.min("node").alias("community"), F.count("*").alias("members")).where(F.col("members") >= least_members)
    return names.join(out, "at").select("node", "community")
