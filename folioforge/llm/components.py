"""Connected components of pairwise matches.

``chain_components`` strips degree-one vertices and compresses degree-two chains by list ranking until the core
is small or has no such vertex left, solves the core with alternating stars, and restores labels to what was
removed. ``hook_components`` is parallel hooking and shortcutting over parent arrays.

Both take pairs with repeats, in either direction, with self-pairs and nulls. A vertex is every non-null value of
either column; a pair with a null or with two equal values connects nothing but its values keep their row. The
group id is the smallest vertex of the group. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import Scratch


def edges_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges (a < b), each once."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    return (
        pairs.filter(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        .distinct()
    )


def vertices_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
    both = F.explode(F.array(F.col(a).cast("long"), F.col(b).cast("long")))
    return pairs.select(both.alias("v")).filter(F.col("v").isNotNull()).distinct()


def _arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over it."""
    both = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("n")), F.struct(F.col("b").alias("v"), F.col("a").alias("n")))
    return edges.select(F.explode(both).alias("e")).select("e.v", "e.n")


def _rank_chains(low: DataFrame, scratch: Scratch) -> DataFrame:
    """List ranking over vertices of degree one or two.

    ``low`` has (v, d, x, y): degree and the one or two neighbours. Each vertex holds one pointer for each
    direction; a pointer (v -> n) moves on to n's other neighbour while n is itself low. Pointer doubling gives
    after log2(length) rounds both ends of the chain and the least vertex on the way. Result:
    (v, end_a, end_b, least): ends are the core vertices the chain hangs on, null for a dead end or a cycle.
    """
    arcs = low.select("v", F.explode(F.array_distinct(F.array("x", "y"))).alias("n"))
    nxt = low.select(F.col("v").alias("n"), F.col("d").alias("nd"), "x", "y")
    # at, to: the arc this pointer has reached; done: 0 moving, 1 ended at a core vertex, 2 at a dead end.
    other = F.when(F.col("x") == F.col("v"), F.col("y")).otherwise(F.col("x"))
    state = scratch.put(
        arcs.join(nxt, "n", "left").select(
            "v",
            "n",
            F.when(F.col("nd").isNull(), F.lit(1)).when(F.col("nd") == 1, F.lit(2)).otherwise(F.lit(0)).alias("done"),
            F.col("n").alias("at"),
            F.when(F.col("nd") == 2, other).alias("to"),
            F.when(F.col("nd").isNull(), F.col("v")).otherwise(F.least("v", "n")).alias("least"),
        )
    )
    moving = state.filter("done = 0").count()
    while moving:
        ahead = state.select(
            F.col("v").alias("at"), F.col("n").alias("to"), F.col("done").alias("done2"), F.col("at").alias("at2"),
            F.col("to").alias("to2"), F.col("least").alias("least2"),
        )
        go = state.filter("done = 0").join(ahead, ["at", "to"], "left")
        moved = go.select(
            "v", "n", F.col("done2").alias("done"), F.col("at2").alias("at"), F.col("to2").alias("to"),
            F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell"),
        )
        new = scratch.put(state.filter("done > 0").withColumn("fell", F.lit(False)).unionByName(moved))
        left = new.filter("done = 0").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("fell").cast("int")).alias("f")).first()
        scratch.drop(state)
        before, state, moving = moving, new.drop("fell"), left["n"]
        state._scratch_path = new._scratch_path
        if moving == before and not left["f"]:
            break  # paths and tails end pointers in every round, so only cycles still move, each with its least vertex on every pointer
    ends = F.when(F.col("done") == 1, F.col("at"))
    ranked = state.groupBy("v").agg(F.min(ends).alias("end_a"), F.max(ends).alias("end_b"), F.min("least").alias("least"))
    out = scratch.put(ranked)
    scratch.drop(state)
    return out


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (v, label) of the core by alternating large and small stars; least vertex of each component."""
    edges = scratch.put(edges)
    mark = None
    while True:
        arcs = _arcs(edges)
        least = arcs.groupBy("v").agg(F.min("n").alias("m")).withColumn("m", F.least("v", "m"))
        large = arcs.filter("n > v").join(least, "v").filter("n <> m").select(F.col("n").alias("b"), F.col("m").alias("a")).distinct()
        big = scratch.put(large.select("a", "b"))
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        joined = big.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = scratch.put(small)
        scratch.drop(edges)
        scratch.drop(big)
        edges = new
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("s"), F.sum("b").alias("t"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark:
            break
        mark = now
    hubs = edges.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct()
    return scratch.put(edges.select(F.col("b").alias("v"), F.col("a").alias("label")).union(hubs))


def chain_components(pairs: DataFrame, a: str, b: str, rounds: int = 12, least_share: float = 0.1) -> DataFrame:
    """(v, group_id) for every vertex; see the module's docstring for nulls, repeats and self-pairs.

    ``rounds``: strip-and-compress rounds at most before the core is solved as it is. ``least_share``: the core
    is also solved once a round would remove less than this share of its vertices. Neither changes the result.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    edges = scratch.put(edges_of(pairs, a, b))
    n_edges = edges.count()
    removed: list[DataFrame] = []
    for _ in range(rounds):
        if not n_edges:
            break
        sides = _arcs(edges).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("x"), F.max("n").alias("y"))
        sides = scratch.put(sides)
        n_all, n_low = sides.agg(F.count(F.lit(1)), F.count_if(F.col("d") <= 2)).first()
        if n_low < least_share * n_all:
            scratch.drop(sides)
            break
        low = sides.filter("d <= 2")
        chains = _rank_chains(low, scratch)
        removed.append(scratch.put(chains.select("v", F.coalesce("end_a", "least").alias("parent"))))
        core = sides.filter("d > 2").select("v")
        kept = edges.join(core.select(F.col("v").alias("a")), "a", "left_semi").join(core.select(F.col("v").alias("b")), "b", "left_semi")
        bridges = chains.filter("end_a < end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"))
        new = scratch.put(kept.select("a", "b").union(bridges).distinct())
        for old in (edges, sides, chains):
            scratch.drop(old)
        edges, n_edges = new, new.count()
    labels = _stars(edges, scratch) if n_edges else scratch.put(edges.select(F.col("a").alias("v"), F.col("b").alias("label")).limit(0))
    for gone in reversed(removed):
        # A parent without a label yet is a finished component's least vertex or an isolated core vertex.
        known = labels.select(F.col("v").alias("parent"), "label")
        back = gone.join(known, "parent", "left").select("v", "parent", F.coalesce("label", "parent").alias("label"))
        lone = back.filter("label = parent").select(F.col("parent").alias("v"), "label").distinct()
        new = scratch.put(labels.union(back.select("v", "label")).union(lone).groupBy("v").agg(F.min("label").alias("label")))
        scratch.drop(labels)
        scratch.drop(gone)
        labels = new
    least = labels.groupBy("label").agg(F.min("v").alias("group_id"))
    named = labels.join(least, "label").select("v", "group_id")
    return vertices_of(pairs, a, b).join(named, "v", "left").select("v", F.coalesce("group_id", "v").alias("group_id"))


def hook_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(v, group_id) of every vertex that an edge touches, by hooking and shortcutting.

    Each round hooks every root that has a smaller root beside it to the least one, shortcuts the parent table by
    joining it with itself until only stars are left, and relabels the edges by their roots. Hooking always goes
    to a smaller root, so the parent table has no cycle; an edge inside one tree falls away.
    """
    scratch = Scratch(pairs.sparkSession, "hooking")
    edges = scratch.put(edges_of(pairs, a, b))
    parents = scratch.put(vertices_of(edges, "a", "b").select("v", F.col("v").alias("p")))
    while not edges.isEmpty():
        hooks = scratch.put(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        while True:  # shortcutting
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("g"))
            new = scratch.put(hooks.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")))
            moved = new.filter("moved").limit(1).count()
            scratch.drop(hooks)
            hooks, kept = new.drop("moved"), new
            hooks._scratch_path = kept._scratch_path
            if not moved:
                break
        root = hooks.select(F.col("v").alias("p"), F.col("p").alias("g"))
        new_parents = scratch.put(parents.join(root, "p", "left").select("v", F.coalesce("g", "p").alias("p")))
        left = hooks.select(F.col("v").alias("a"), F.col("p").alias("ga"))
        right = hooks.select(F.col("v").alias("b"), F.col("p").alias("gb"))
        ga, gb = F.coalesce("ga", "a"), F.coalesce("gb", "b")
        new_edges = scratch.put(
            edges.join(left, "a", "left").join(right, "b", "left").select(F.least(ga, gb).alias("a"), F.greatest(ga, gb).alias("b")).filter("a <> b").distinct()
        )
        for old in (hooks, parents, edges):
            scratch.drop(old)
        parents, edges = new_parents, new_edges
    return parents.select("v", F.col("p").alias("group_id"))
