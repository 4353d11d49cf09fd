"""Traversals: reachability, breadth-first orders, witnesses, edge walks, ancestors, chases."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators import whole
from arcstep.operators.frames import HOPS, checkpoint, closure, dense_ids, discard, pinned
from arcstep.operators.graph import Graph


def steps(graph: Graph, direction: str = "forward", where: Column | str | None = None) -> DataFrame:
    """(graph_id, src, dst, edge_id, out_rank) in walking direction; ``where`` is applied to the stored edges."""
    edges = graph.live()
    if where is not None:
        edges = edges.where(where)
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    rank = (F.row_number().over(W.partitionBy("graph_id", a).orderBy("edge_id")) - 1).cast("long")
    return edges.select("graph_id", F.col(a).alias("src"), F.col(b).alias("dst"), "edge_id", rank.alias("out_rank"))


def _ends(graph: Graph, direction: str, where: Column | str | None = None) -> DataFrame:
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    edges = graph.live() if where is None else graph.live().where(where)
    return edges.select("graph_id", F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def _parted(graph: Graph, where: Column | str | None = None) -> tuple[Graph, Graph | None]:
    """The small and the large graphs with the edges that fulfil ``where``."""
    return whole.parted(graph if where is None else replace(graph, edges=graph.edges.where(where)))


def reachable(graph: Graph, seeds: DataFrame, direction: str = "forward", where: Column | str | None = None) -> DataFrame:
    """(graph_id, node_id) of the nodes that any of the seeds (graph_id, node_id) reaches, seeds included."""
    small, large = _parted(graph, where)
    found = whole.solved(whole.edges(small, direction).unionByName(whole.marks(seeds if large is None else whole.without(seeds, large))), whole.reached_kernel, "node_id bigint")
    if large is None:
        return checkpoint(found)
    ends = pinned(_ends(large, direction), "graph_id", "src")
    step = lambda f: f.withColumnRenamed("node_id", "src").join(ends, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"))
    return checkpoint(found).unionByName(closure(whole.of(seeds, large).select("graph_id", "node_id"), step, ["graph_id", "node_id"]))


def distances(
    graph: Graph, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None, where: Column | str | None = None, skip: Column | str | None = None
) -> DataFrame:
    """(graph_id, node_id, depth): breadth-first depth; nodes that satisfy ``skip`` are reached, not expanded.

    Other columns of the seeds, such as a search's own key, can be part of graph_id.
    """
    if skip is None:
        small, large = _parted(graph, where)
        rows = whole.edges(small, direction).unionByName(whole.marks(seeds if large is None else whole.without(seeds, large)))
        found = checkpoint(whole.solved(rows, partial(whole.depths_kernel, most=max_depth), "node_id bigint, depth bigint"))
        return found if large is None else found.unionByName(distances_by_rounds(large, whole.of(seeds, large), direction, max_depth))
    return distances_by_rounds(graph, seeds, direction, max_depth, where, skip)


def distances_by_rounds(
    graph: Graph, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None, where: Column | str | None = None, skip: Column | str | None = None
) -> DataFrame:
    """As ``distances``, without any graph in one place."""
    ends = pinned(_ends(graph, direction, where), "graph_id", "src")

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier if skip is None else frontier.where(~F.expr(skip) if isinstance(skip, str) else ~skip)
        return f.withColumnRenamed("node_id", "src").join(ends, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), (F.col("depth") + 1).alias("depth"))

    start = seeds.select("graph_id", "node_id", F.lit(0).cast("long").alias("depth"))
    return closure(start, step, ["graph_id", "node_id"], max_depth, {"depth": F.min("depth")}, HOPS if max_depth is None else None).select("graph_id", "node_id", "depth")


def breadth_first(graph: Graph, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None, where: Column | str | None = None) -> DataFrame:
    """(graph_id, node_id, depth, rank, parent, edge_id) in exact discovery order.

    A node is discovered by the first discovered neighbour of the level before,
    through its first edge there; ranks number a level on from the last one. Seeds
    come in the order of their ids.
    """
    small, large = _parted(graph, where)
    rows = _with_ids(whole.edges(small, direction, "edge_id"), whole.marks(seeds if large is None else whole.without(seeds, large)))
    found = checkpoint(whole.solved(rows, partial(whole.order_kernel, most=max_depth), "node_id bigint, depth bigint, rank bigint, parent bigint, edge_id bigint"))
    return found if large is None else found.unionByName(breadth_first_by_rounds(large, whole.of(seeds, large), direction, max_depth))


def _with_ids(edges: DataFrame, *marks: DataFrame) -> DataFrame:
    for part in marks:
        edges = edges.unionByName(part.withColumn("edge_id", F.lit(-1).cast("long")))
    return edges


def breadth_first_by_rounds(graph: Graph, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None, where: Column | str | None = None) -> DataFrame:
    """As ``breadth_first``, without any graph in one place."""
    ends = pinned(steps(graph, direction, where), "graph_id", "src")
    null = F.lit(None).cast("long")
    first = dense_ids(seeds.select("graph_id", "node_id").distinct(), ["node_id"], "rank", ["graph_id"])
    level = checkpoint(first.select("graph_id", "node_id", F.lit(0).cast("long").alias("depth"), "rank", null.alias("parent"), null.alias("edge_id")))
    known, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = checkpoint(
            level.select("graph_id", F.col("node_id").alias("src"), "rank").join(ends, ["graph_id", "src"])
            .select("graph_id", F.col("dst").alias("node_id"), F.struct("rank", "out_rank", F.col("src").alias("parent"), "edge_id").alias("key"))
            .groupBy("graph_id", "node_id").agg(F.min("key").alias("key"))
            .join(known.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
        )
        if found.isEmpty():
            break
        last = level.groupBy("graph_id").agg((F.max("rank") + 1).alias("last"))
        level = checkpoint(
            dense_ids(found, ["key"], "k", ["graph_id"]).join(last, "graph_id").select(
                "graph_id", "node_id", F.lit(depth).cast("long").alias("depth"), (F.col("last") + F.col("k")).alias("rank"),
                F.col("key.parent").alias("parent"), F.col("key.edge_id").alias("edge_id"),
            )
        )
        known = known.unionByName(level)
        if depth % 8 == 0:
            known = checkpoint(known)
    return known


def shortest_path(graph: Graph, pairs: DataFrame, direction: str = "forward") -> DataFrame:
    """(graph_id, pos, node_id, edge_id) of one shortest path for (graph_id, start, goal); none if there is none."""
    small, large = whole.parted(graph)
    own = pairs if large is None else whole.without(pairs, large)
    rows = _with_ids(whole.edges(small, direction, "edge_id"), whole.marks(own, 1, "start"), whole.marks(own, 2, "goal"))
    found = checkpoint(whole.solved(rows, whole.path_kernel, "pos bigint, node_id bigint, edge_id bigint"))
    return found if large is None else found.unionByName(shortest_path_by_rounds(large, whole.of(pairs, large), direction))


def shortest_path_by_rounds(graph: Graph, pairs: DataFrame, direction: str = "forward") -> DataFrame:
    """As ``shortest_path``, without any graph in one place."""
    order = checkpoint(breadth_first_by_rounds(graph, pairs.select("graph_id", F.col("start").alias("node_id")), direction))
    at = pairs.select("graph_id", F.col("goal").alias("node_id")).join(order, ["graph_id", "node_id"])
    path = closure(
        at.select("graph_id", "node_id", "depth", "parent", "edge_id"),
        lambda f: f.select("graph_id", F.col("parent").alias("node_id")).join(order, ["graph_id", "node_id"]).select("graph_id", "node_id", "depth", "parent", "edge_id"),
        ["graph_id", "node_id"], best={c: F.first(c) for c in ("depth", "parent", "edge_id")},
    )
    return path.select("graph_id", F.col("depth").alias("pos"), "node_id", "edge_id")


def walk_edges(graph: Graph, seeds: DataFrame, direction: str = "forward", max_depth: int | None = None, where: Column | str | None = None) -> DataFrame:
    """(graph_id, edge_id, src, dst, depth): every accepted edge leaving a reached node, once; rejected edges do not reach."""
    reached = breadth_first(graph, seeds, direction, None if max_depth is None else max(0, max_depth - 1), where)
    if max_depth == 0:
        reached = reached.limit(0)
    return reached.select("graph_id", F.col("node_id").alias("src"), (F.col("depth") + 1).alias("depth"), "rank").join(steps(graph, direction, where), ["graph_id", "src"]).select(
        "graph_id", "edge_id", "src", "dst", "depth", "rank", "out_rank"
    )


def common_ancestors(graph: Graph, pairs: DataFrame, direction: str = "backward", max_depth: int | None = None) -> DataFrame:
    """(graph_id, node_id, from_a, from_b, combined) for (graph_id, a, b): nodes that both reach, with both distances."""
    small, large = whole.parted(graph)
    own = pairs if large is None else whole.without(pairs, large)
    rows = whole.edges(small, direction).unionByName(whole.marks(own, 1, "a")).unionByName(whole.marks(own, 2, "b"))
    found = checkpoint(whole.solved(rows, partial(whole.common_kernel, most=max_depth), "node_id bigint, from_a bigint, from_b bigint"))
    found = found.withColumn("combined", F.col("from_a") + F.col("from_b"))
    return found if large is None else found.unionByName(common_ancestors_by_rounds(large, whole.of(pairs, large), direction, max_depth))


def common_ancestors_by_rounds(graph: Graph, pairs: DataFrame, direction: str = "backward", max_depth: int | None = None) -> DataFrame:
    """As ``common_ancestors``, without any graph in one place."""
    side = lambda c, n: distances_by_rounds(graph, pairs.select("graph_id", F.col(c).alias("node_id")), direction, max_depth).withColumnRenamed("depth", n)
    return side("a", "from_a").join(side("b", "from_b"), ["graph_id", "node_id"]).withColumn("combined", F.col("from_a") + F.col("from_b"))


def nearest_common_ancestor(graph: Graph, pairs: DataFrame, direction: str = "backward") -> DataFrame:
    """(graph_id, node_id): the common ancestor with the least combined distance, ties to the least node."""
    best = common_ancestors(graph, pairs, direction).groupBy("graph_id").agg(F.min(F.struct("combined", "node_id")).alias("m"))
    return best.select("graph_id", F.col("m.node_id").alias("node_id"), F.col("m.combined").alias("combined"))


def topological_levels(graph: Graph) -> DataFrame:
    """(graph_id, node_id, level) of the nodes not on or behind a cycle: longest path from a source."""
    edges = checkpoint(graph.live().groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("k")))
    need = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("k").alias("need"))
    waiting = checkpoint(graph.nodes.select("graph_id", "node_id").join(need, ["graph_id", "node_id"], "left").fillna(0, ["need"]))
    done, level = None, 0
    while True:
        free = checkpoint(waiting.where("need = 0").select("graph_id", "node_id", F.lit(level).cast("long").alias("level")))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        paid = free.select("graph_id", F.col("node_id").alias("src")).join(edges, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("k").alias("paid"))
        waiting = checkpoint(
            waiting.where("need > 0").join(paid, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.col("need") - F.coalesce("paid", F.lit(0))).alias("need"))
        )
        level += 1
        if level % 8 == 0:
            done = checkpoint(done)
    return done if done is not None else waiting.select("graph_id", "node_id", F.lit(0).cast("long").alias("level")).limit(0)


def topological_order(graph: Graph) -> DataFrame:
    """(graph_id, node_id, level) of the acyclic graphs only."""
    levels = topological_levels(graph)
    whole = levels.groupBy("graph_id").agg(F.count(F.lit(1)).alias("done")).join(graph.node_count(), "graph_id").where("done = nodes").select("graph_id")
    return levels.join(whole, "graph_id", "left_semi")


def follow(links: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(graph_id, seed, hop, node_id): the chain of (graph_id, node_id, next) rows from each seed.

    A chain ends after ``max_hops`` where that is given, where no link goes on, or before a node that it has already passed.
    """
    hops = links.select("graph_id", F.col("node_id").alias("at"), "next")
    frontier = checkpoint(seeds.select("graph_id", F.col("node_id").alias("seed"), F.lit(0).cast("long").alias("hop"), "node_id", F.array("node_id").alias("path")))
    chain = frontier
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        frontier = checkpoint(
            frontier.withColumnRenamed("node_id", "at").join(hops, ["graph_id", "at"])
            .where(~F.array_contains("path", F.col("next")))
            .select("graph_id", "seed", F.lit(hop).cast("long").alias("hop"), F.col("next").alias("node_id"), F.concat("path", F.array("next")).alias("path"))
        )
        if frontier.isEmpty():
            break
        chain = chain.unionByName(frontier)
        if hop % 8 == 0:
            chain = checkpoint(chain)
    return chain.drop("path")


def chase(links: DataFrame, stored: bool = False) -> DataFrame:
    """(graph_id, node_id, end, hops): where the chain of (graph_id, node_id, next) rows from each node ends.

    ``stored`` says that the links are a written table already.

    Pointer doubling: rounds grow with the logarithm of the longest chain, and a
    row never holds a path. Nodes that lead into a ring have no end and no row.
    """
    links = links.select("graph_id", "node_id", F.col("next").alias("at"), F.lit(1).cast("long").alias("hops"))
    state = links.withColumn("done", F.lit(False))
    state = state if stored else checkpoint(state)
    before = 0
    while True:
        # Two doublings a job: on short chains the number of jobs is what takes time.
        last, state = state, checkpoint(_doubled(_doubled(state)))
        discard(last)
        total, ended = state.agg(F.count(F.lit(1)), F.count(F.when(F.col("done"), 1))).first()
        if ended in (before, total):
            return state.where("done").select("graph_id", "node_id", F.col("at").alias("end"), "hops")
        before = ended


def _doubled(state: DataFrame) -> DataFrame:
    onward = state.select("graph_id", F.col("node_id").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("done").alias("ended"))
    return state.join(onward, ["graph_id", "at"], "left").select(
        "graph_id", "node_id",
        F.when(F.col("done"), F.col("at")).otherwise(F.coalesce("to", "at")).alias("at"),
        F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
        (F.col("done") | F.col("to").isNull() | F.col("ended")).alias("done"),
    )
