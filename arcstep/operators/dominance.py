"""Dominators, post-dominators, frontiers, control dependence, back edges and loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcstep.operators import domtree, whole
from arcstep.operators.domtree import dominates, tree_jumps
from arcstep.operators.frames import checkpoint, closure
from arcstep.operators.graph import Graph

KEY = ["graph_id", "node_id"]


def dominators(graph: Graph, roots: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, dom) for the nodes reachable from the root, each dominating itself.

    The ancestors in the dominator tree, one row for each level of a node's depth in
    it, as explicit dominators need; what only asks for parents, common dominators or
    whether one node dominates another can use the tree (``domtree``) itself. Graphs that fit
    a task are solved there (``whole``).
    """
    roots = graph.roots if roots is None else roots
    found, large, heads = _solved(graph, roots, whole.dominators_kernel, "node_id bigint, dom bigint")
    return found if large is None else found.unionByName(domtree.parents_and_jumps(large, heads)[1].ancestors())


def immediate_dominators(graph: Graph, roots: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, idom, depth) of the nodes that a root reaches, as ``domtree`` has them; graphs that fit a task are solved there (``whole``)."""
    roots = graph.roots if roots is None else roots
    found, large, heads = _solved(graph, roots, whole.tree_kernel, "node_id bigint, idom bigint, depth bigint")
    return found if large is None else found.unionByName(domtree.immediate_dominators(large, heads))


def _solved(graph: Graph, roots: DataFrame, kernel: Callable, schema: str) -> tuple[DataFrame, Graph | None, DataFrame]:
    """What ``kernel`` makes of the small graphs, the large ones and the roots of these."""
    small, large = whole.parted(graph)
    heads = roots if large is None else whole.without(roots, large)
    rows = whole.edges(small).unionByName(whole.marks(heads, node="root"))
    return checkpoint(whole.solved(rows, kernel, schema)), large, roots if large is None else whole.of(roots, large)


def post_dominators(graph: Graph, exits: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, dom) over reversed edges from a virtual exit behind all exits.

    Without exits a graph's last node stands in. Nodes that reach no exit have no rows.
    """
    return dominators(graph.reversed(), _exits(graph, exits))


def post_dominator_tree(graph: Graph, exits: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, idom, depth) of the same; null where only the virtual exit is behind a node."""
    return immediate_dominators(graph.reversed(), _exits(graph, exits))


def _exits(graph: Graph, exits: DataFrame | None) -> DataFrame:
    if exits is None:
        own = graph.exits()
        without = graph.nodes.groupBy("graph_id").agg(F.max("node_id").alias("node_id")).join(own, "graph_id", "left_anti")
        exits = own.unionByName(without.select(*KEY))
    return exits.select("graph_id", F.col("node_id").alias("root")).distinct()


def dominator_tree(dom: DataFrame) -> DataFrame:
    """(graph_id, node_id, idom, depth): the strict dominator with most dominators; null and depth 0 at a root."""
    depth = dom.groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("depth"))
    above = dom.where("node_id <> dom").join(depth.select("graph_id", F.col("node_id").alias("dom"), F.col("depth").alias("d")), ["graph_id", "dom"])
    idom = above.groupBy(*KEY).agg(F.max_by("dom", "d").alias("idom"))
    return depth.join(idom, KEY, "left").select("graph_id", "node_id", "idom", "depth")


def changed_dominators(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, node_id, old, new): nodes whose immediate dominator differs between two trees."""
    side = lambda t, n: t.select("graph_id", "node_id", F.col("idom").alias(n), F.lit(True).alias(f"in_{n}"))
    both = side(before, "old").join(side(after, "new"), KEY, "full")
    return both.where("not (old <=> new) or not (in_old <=> in_new)").select("graph_id", "node_id", "old", "new")


def dominance_frontier(graph: Graph, dom: DataFrame) -> DataFrame:
    """(graph_id, node_id, frontier): joins (two or more in-edges, parallel ones counted) not strictly dominated.

    For a join b and a predecessor p every dominator of p that does not strictly
    dominate b has b in its frontier; an unreachable predecessor contributes itself.
    """
    edges = graph.live()
    joins = edges.groupBy("graph_id", F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", "b")
    pairs = edges.select("graph_id", F.col("src").alias("p"), F.col("dst").alias("b")).distinct().join(joins, ["graph_id", "b"])
    runners = pairs.join(dom.select("graph_id", F.col("node_id").alias("p"), "dom"), ["graph_id", "p"], "left").select("graph_id", "b", F.coalesce("dom", "p").alias("node_id"))
    strict = dom.where("node_id <> dom").select("graph_id", F.col("node_id").alias("b"), F.col("dom").alias("node_id"))
    return runners.distinct().join(strict, ["graph_id", "b", "node_id"], "left_anti").select("graph_id", "node_id", F.col("b").alias("frontier"))


def control_dependence(graph: Graph, pdom: DataFrame) -> DataFrame:
    """(graph_id, controller, dependent): dependent post-dominates a successor of controller, not strictly controller itself.

    Ends that reach no exit are left out; a loop header may depend on itself.
    """
    ok = pdom.select(*KEY).distinct()
    edges = graph.live().select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    edges = edges.join(ok.withColumnRenamed("node_id", "a"), ["graph_id", "a"], "left_semi")
    up = edges.join(pdom.select("graph_id", F.col("node_id").alias("b"), F.col("dom").alias("dependent")), ["graph_id", "b"])
    strict = pdom.where("node_id <> dom").select("graph_id", F.col("node_id").alias("a"), F.col("dom").alias("dependent"))
    return up.select("graph_id", "a", "dependent").distinct().join(strict, ["graph_id", "a", "dependent"], "left_anti").withColumnRenamed("a", "controller")


def back_edges(graph: Graph, dom: DataFrame, tagged: bool = False) -> DataFrame:
    """(graph_id, src, dst): edges whose target dominates the source, self edges always; with ``tagged`` also edges of kind Back."""
    edges = graph.live()
    by_dominance = edges.join(dom.select("graph_id", F.col("node_id").alias("src"), F.col("dom").alias("dst")), ["graph_id", "src", "dst"], "left_semi")
    found = by_dominance.select("graph_id", "src", "dst").unionByName(edges.where("src = dst").select("graph_id", "src", "dst"))
    if tagged:
        found = found.unionByName(edges.where("kind = 'Back'").select("graph_id", "src", "dst"))
    return found.distinct()


def tree_back_edges(graph: Graph, tree: DataFrame, tagged: bool = False) -> DataFrame:
    """As ``back_edges``, from the dominator tree instead of explicit dominators."""
    edges = graph.live().select("graph_id", "src", "dst").distinct()
    found = dominates(tree_jumps(tree), edges.where("src <> dst"), "dst", "src").unionByName(edges.where("src = dst"))
    if tagged:
        found = found.unionByName(graph.live().where("kind = 'Back'").select("graph_id", "src", "dst"))
    return found.distinct()


def loop_bodies(graph: Graph, backs: DataFrame) -> DataFrame:
    """(graph_id, header, node_id): natural loops, those of one header merged."""
    turned = checkpoint(graph.live().select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("prev")).distinct())
    seeds = backs.select("graph_id", F.col("dst").alias("header"), F.col("src").alias("node_id")).unionByName(
        backs.select("graph_id", F.col("dst").alias("header"), F.col("dst").alias("node_id"))
    )
    step = lambda f: f.where("node_id <> header").join(turned, KEY).select("graph_id", "header", F.col("prev").alias("node_id"))
    return closure(seeds, step, ["graph_id", "header", "node_id"])


def loops(graph: Graph, backs: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """(graph_id, header, latches, size, depth, parent): parent is the smallest other body that contains the header."""
    bodies = loop_bodies(graph, backs) if bodies is None else bodies
    size = bodies.groupBy("graph_id", "header").agg(F.count(F.lit(1)).alias("size"))
    latches = backs.groupBy("graph_id", F.col("dst").alias("header")).agg(F.count(F.lit(1)).alias("latches"))
    around = (
        bodies.select("graph_id", F.col("header").alias("outer"), F.col("node_id").alias("header"))
        .join(size.select("graph_id", "header"), ["graph_id", "header"], "left_semi")
        .join(size.select("graph_id", F.col("header").alias("outer"), F.col("size").alias("outer_size")), ["graph_id", "outer"])
    )
    depth = around.groupBy("graph_id", "header").agg((F.count(F.lit(1)) - 1).alias("depth"))
    parent = around.where("outer <> header").groupBy("graph_id", "header").agg(F.min(F.struct("outer_size", "outer")).alias("m"))
    key = ["graph_id", "header"]
    joined = size.join(latches, key).join(depth, key).join(parent, key, "left")
    return joined.select("graph_id", "header", "latches", "size", "depth", F.col("m.outer").alias("parent"))


def loop_exits(graph: Graph, bodies: DataFrame) -> DataFrame:
    """(graph_id, header, exit): targets outside of a loop of edges from its body."""
    out = bodies.join(graph.live().select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("exit")), KEY)
    inside = bodies.select("graph_id", "header", F.col("node_id").alias("exit"))
    return out.select("graph_id", "header", "exit").distinct().join(inside, ["graph_id", "header", "exit"], "left_anti")


def nesting_depth(graph: Graph, bodies: DataFrame) -> DataFrame:
    """(graph_id, node_id, depth): how many loops contain each node."""
    depth = bodies.groupBy(*KEY).agg(F.count(F.lit(1)).alias("depth"))
    return graph.nodes.select(*KEY).join(depth, KEY, "left").fillna(0, ["depth"])


def innermost_loop(bodies: DataFrame) -> DataFrame:
    """(graph_id, node_id, header): the smallest loop around a node, ties to the least header."""
    size = bodies.groupBy("graph_id", "header").agg(F.count(F.lit(1)).alias("size"))
    best = bodies.join(size, ["graph_id", "header"]).groupBy(*KEY).agg(F.min(F.struct("size", "header")).alias("m"))
    return best.select("graph_id", "node_id", F.col("m.header").alias("header"))


def reducible(graph: Graph, dom: DataFrame) -> DataFrame:
    """(graph_id, reducible): without its back edges the reachable part has no cycle."""
    return acyclic_but_for(graph, dom.select(*KEY).distinct(), back_edges(graph, dom))


def acyclic_but_for(graph: Graph, live: DataFrame, backs: DataFrame) -> DataFrame:
    """(graph_id, reducible): whether the live nodes span no cycle without the (graph_id, src, dst) edges of ``backs``."""
    from arcstep.operators.traverse import topological_levels

    inside = graph.live().join(live.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    forward = checkpoint(inside.join(backs, ["graph_id", "src", "dst"], "left_anti"))
    nodes = checkpoint(live.withColumn("payload", F.lit(None).cast("string")))
    order = topological_levels(Graph(nodes, forward)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("done"))
    count = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return count.join(order, "graph_id", "left").select("graph_id", (F.coalesce("done", F.lit(0)) == F.col("n")).alias("reducible"))


def insert_preheaders(graph: Graph, bodies: DataFrame) -> tuple[Graph, DataFrame]:
    """A new block before each loop header with two or more in-edges from outside; weights of redirected edges are lost.

    Returns the graph and (graph_id, header, preheader).
    """
    from pyspark.sql import Window as W

    inside = bodies.select("graph_id", F.col("header").alias("dst"), F.col("node_id").alias("src"))
    headers = bodies.select("graph_id", F.col("header").alias("dst")).distinct()
    outside = graph.live().join(headers, ["graph_id", "dst"], "left_semi").join(inside, ["graph_id", "dst", "src"], "left_anti")
    many = outside.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = graph.nodes.groupBy("graph_id").agg(F.max("node_id").alias("top"))
    new = many.join(top, "graph_id").select(
        "graph_id", F.col("dst").alias("header"), (F.col("top") + F.row_number().over(W.partitionBy("graph_id").orderBy("dst"))).alias("preheader")
    )
    moved = outside.select("graph_id", "edge_id", "dst").join(new.withColumnRenamed("header", "dst"), ["graph_id", "dst"]).select("graph_id", "edge_id", "preheader")
    edges = graph.edges.join(moved, ["graph_id", "edge_id"], "left").select(
        "graph_id", "edge_id", "src", F.coalesce("preheader", "dst").alias("dst"), "kind",
        F.when(F.col("preheader").isNull(), F.col("weight")).alias("weight"), "live",
    )
    slots = graph.edge_slots()
    falls = new.join(slots, "graph_id").select(
        "graph_id", (F.col("slots") + F.row_number().over(W.partitionBy("graph_id").orderBy("header")) - 1).alias("edge_id"),
        F.col("preheader").alias("src"), F.col("header").alias("dst"), F.lit("Fallthrough").alias("kind"), F.lit(None).cast("double").alias("weight"), F.lit(True).alias("live"),
    )
    nodes = graph.nodes.unionByName(new.select("graph_id", F.col("preheader").alias("node_id"), F.lit(None).cast("string").alias("payload")))
    return Graph(nodes, edges.unionByName(falls), graph.roots), new
