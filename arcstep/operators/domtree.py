"""Immediate dominators as a tree: spanning trees by contraction, common ancestors by jump tables.

A node has one row in the tree and one for each power of two up to its depth in the
jump tables; neither a set of dominators nor a path is ever held, and no loop here
takes a round for each level of a chain.

1. A spanning tree. A node that only one other node leads to is hung below it, and
   whole chains of these are followed by pointer doubling; what hangs below a node
   becomes one with it. That goes on until nothing is left but the root (always so
   for reducible graphs), or a core in which several nodes lead to every node. The
   core is walked breadth first from the root.
2. Every node's parent becomes the lowest common ancestor of the nodes that lead to
   it, all at once, until no parent moves. A node's dominators are ancestors of it in
   every one of these trees: they lie on each path to it, and a parent's dominators
   lie above the parent. A tree that no step changes fulfils the equations of
   dominance, so its ancestors are dominators.

The parents of all roots are one node above them, ``ABOVE``, which is in no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcstep.operators.frames import checkpoint, closure, discard
from arcstep.operators.graph import Graph
from arcstep.operators.traverse import chase

#: The id of the node above all roots.
ABOVE = -(1 << 62)

KEY = ["graph_id", "node_id"]

#: Levels of jump tables that one plan walks; the driver holds the broadcasts of a plan's joins at the same time.
WALK = 4


class Jumps:
    """Ancestors of the nodes of trees at distances of powers of two.

    ``levels[j]`` has (graph_id, node_id, up, hops): the ancestor 2^j above, or ``ABOVE`` if
    there are fewer, and how far that is. The last level leads from every node to
    ``ABOVE``, so its hops are the depths, from 1 at a root. Nodes that ``parents``
    (graph_id, node_id, parent) do not connect with ``ABOVE`` are in no level but the first ones.
    """

    def __init__(self, parents: DataFrame) -> None:
        state = parents.select(*KEY, F.col("parent").alias("up"), F.lit(1).cast("long").alias("hops"))
        self.levels: list[DataFrame] = []
        self._stored: list[DataFrame] = []
        ended = -1
        while True:
            # Two levels a job: on shallow trees the number of jobs is what takes time.
            states = [state, _further(state)]
            stored = checkpoint(states[0].withColumn("at", F.lit(0)).unionByName(states[1].withColumn("at", F.lit(1))))
            self._stored.append(stored)
            states = [stored.where(F.col("at") == k).drop("at") for k in range(2)]
            self.levels += states
            total, done = states[1].agg(F.count(F.lit(1)), F.count(F.when(F.col("up") == ABOVE, 1))).first()
            if done in (ended, total):  # a depth that no node has is beyond all nodes
                break
            ended = done
            state = _further(states[1])

    def depths(self, node: str = "node_id", name: str = "depth") -> DataFrame:
        """(graph_id, node, depth) of the nodes below ``ABOVE``."""
        return self.levels[-1].where(F.col("up") == ABOVE).select("graph_id", F.col("node_id").alias(node), F.col("hops").alias(name))

    def _joined(self, rows: DataFrame, j: int, node: str, name: str) -> DataFrame:
        up = self.levels[j].select("graph_id", F.col("node_id").alias(node), F.col("up").alias(name))
        return rows.join(up, ["graph_id", node], "left")

    def _cut(self, rows: DataFrame, j: int) -> DataFrame:
        """``rows`` as a written table before each ``WALK`` levels of a walk down to level ``j`` but the first."""
        if (j + 1) % WALK or j + 1 == len(self.levels):
            return rows
        rows = checkpoint(rows)
        self._stored.append(rows)
        return rows

    def lifted(self, rows: DataFrame, node: str, by: str) -> DataFrame:
        """``rows`` with each ``node`` replaced by its ancestor ``by`` levels above."""
        columns = rows.columns
        for j in reversed(range(len(self.levels))):
            rows = self._cut(rows, j)
            take = (F.col(by) >= 1 << j) & F.col("__up").isNotNull()
            rows = self._joined(rows, j, node, "__up").select(
                *[F.when(take, F.col("__up")).otherwise(F.col(c)).alias(c) if c == node else F.when(take, F.col(c) - (1 << j)).otherwise(F.col(c)).alias(c) if c == by else F.col(c) for c in columns]
            )
        return rows

    def leveled(self, rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """``rows`` with the deeper one of each pair lifted to the other's depth, which ``level`` has; pairs with a node outside of the trees are dropped."""
        columns = [c for c in rows.columns if c not in (a, b)]
        deep = lambda n, d: self.depths(n, d)
        rows = rows.join(deep(a, "__a"), ["graph_id", a], "left").join(deep(b, "__b"), ["graph_id", b], "left")
        zero = lambda n, d: F.when(F.col(n) == ABOVE, F.lit(0).cast("long")).otherwise(F.col(d))
        rows = rows.withColumn("__a", zero(a, "__a")).withColumn("__b", zero(b, "__b")).where("__a is not null and __b is not null")
        lower = F.col("__a") >= F.col("__b")
        rows = rows.select(
            *columns, F.when(lower, F.col(a)).otherwise(F.col(b)).alias(a), F.when(lower, F.col(b)).otherwise(F.col(a)).alias(b),
            F.least("__a", "__b").alias("level"), F.abs(F.col("__a") - F.col("__b")).alias("__by"),
        )
        return self.lifted(rows, a, "__by").drop("__by")

    def common(self, rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """``rows`` with ``lca``, the lowest common ancestor of each pair, and its depth as ``level``; columns a and b are lost."""
        return self.met(checkpoint(self.leveled(rows, a, b)), a, b)

    def met(self, rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """As ``common``, for rows of ``leveled``."""
        columns = [c for c in rows.columns if c not in (a, b, "level")]
        for j in reversed(range(len(self.levels))):
            rows = self._cut(rows, j)
            rows = self._joined(self._joined(rows, j, a, "__a"), j, b, "__b")
            apart = F.col("__a") != F.col("__b")  # null at ABOVE, where nothing moves
            rows = rows.select(
                *columns, F.when(apart, F.col("__a")).otherwise(F.col(a)).alias(a), F.when(apart, F.col("__b")).otherwise(F.col(b)).alias(b),
                F.when(apart, F.col("level") - (1 << j)).otherwise(F.col("level")).alias("level"),
            )
        rows = self._joined(rows, 0, a, "__a")
        same = F.col(a) == F.col(b)
        return rows.select(*columns, F.when(same, F.col(a)).otherwise(F.col("__a")).alias("lca"), F.when(same, F.col("level")).otherwise(F.col("level") - 1).alias("level"))

    def ancestors(self) -> DataFrame:
        """(graph_id, node_id, dom): every node with itself and all its ancestors, in as many rounds as there are levels."""
        known = self.depths().select(*KEY, F.col("node_id").alias("dom"))
        for j, level in enumerate(self.levels):
            step = level.where((F.col("hops") == 1 << j) & (F.col("up") != ABOVE)).select("graph_id", F.col("node_id").alias("low"), F.col("up").alias("node_id"))
            known = checkpoint(known.unionByName(step.join(known, KEY).select("graph_id", F.col("low").alias("node_id"), "dom")))
        return known

    def discard(self) -> None:
        discard(*self._stored)


def _further(state: DataFrame) -> DataFrame:
    """Twice as far up; what leads nowhere but to a node without a parent is dropped."""
    onward = state.select("graph_id", F.col("node_id").alias("up"), F.col("up").alias("to"), F.col("hops").alias("more"))
    return state.join(onward, ["graph_id", "up"], "left").where(F.col("to").isNotNull() | (F.col("up") == ABOVE)).select(
        *KEY, F.coalesce("to", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")
    )


def _edges(graph: Graph, roots: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, and those from ``ABOVE`` to the roots."""
    inner = graph.live().where("src <> dst").select("graph_id", "src", "dst")
    return inner.unionByName(roots.select("graph_id", F.lit(ABOVE).alias("src"), F.col("root").alias("dst"))).distinct()


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, parent): for every node that ``ABOVE`` reaches over (graph_id, src, dst) one of its predecessors, so that the parents form a tree.

    Some nodes that it does not reach have rows, too; their chains of parents end elsewhere.
    """
    # ``pred`` is the node itself that the edge leaves, ``src`` what it has become one with, so many joins above.
    left = checkpoint(edges.select("graph_id", "src", "dst", F.struct(F.lit(0).cast("long").alias("joins"), F.col("src").alias("pred")).alias("via")))
    parts = []
    size = left.count()
    while size:
        # What nothing leads to is not reached; so it leads nowhere.
        alive = left.join(left.select("graph_id", F.col("dst").alias("src")).distinct(), ["graph_id", "src"], "left_semi").unionByName(left.where(F.col("src") == ABOVE))
        single = alive.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src"), F.min("via").alias("via")).where("n = 1")
        hung = checkpoint(single.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("next"), F.col("via.pred").alias("parent")))
        ends = chase(hung.select(*KEY, "next"), stored=True)
        placed = hung.join(ends.select(*KEY, "end", "hops"), KEY, "left")  # rings have no end
        parts.append(placed.where("end is not null").select(*KEY, "parent"))
        keys = hung.select("graph_id", F.col("node_id").alias("dst"))
        heads = placed.select("graph_id", F.col("node_id").alias("src"), F.col("end"), F.col("hops"), F.lit(True).alias("inner"))
        moved = alive.join(keys, ["graph_id", "dst"], "left_anti").join(heads, ["graph_id", "src"], "left").where("inner is null or end is not null")
        moved = moved.select(
            "graph_id", F.coalesce("end", "src").alias("src"), "dst", F.struct((F.col("via.joins") + F.coalesce("hops", F.lit(0))).alias("joins"), F.col("via.pred").alias("pred")).alias("via")
        )
        last, left = left, checkpoint(moved.where("src <> dst").groupBy("graph_id", "src", "dst").agg(F.min("via").alias("via")))
        discard(last)
        before, size = size, left.count()
        if size == before:
            break
    if size:
        core = left.select("graph_id", "src", "dst", F.col("via.pred").alias("parent"))
        start = core.where(F.col("src") == ABOVE).select("graph_id", F.col("src").alias("node_id"), F.lit(None).cast("long").alias("parent")).distinct()
        step = lambda f: f.select("graph_id", F.col("node_id").alias("src")).join(core, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), "parent")
        parts.append(closure(start, step, KEY, best={"parent": F.min("parent")}).where("parent is not null").select(*KEY, "parent"))
    out = edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("parent")).limit(0)
    for part in parts:
        out = out.unionByName(part)
    return checkpoint(out)


def parents_and_jumps(graph: Graph, roots: DataFrame | None = None) -> tuple[DataFrame, Jumps]:
    """(graph_id, node_id, parent), the dominator trees below ``ABOVE``, and their jump tables."""
    edges = checkpoint(_edges(graph, graph.roots if roots is None else roots))
    parents = spanning_tree(edges)
    jumps = Jumps(parents)
    # The core of a graph that cannot be contracted takes rounds for its depth here, all others a few.
    parents = jumps.depths().select(*KEY).join(parents, KEY)
    # Only nodes that several reached nodes lead to can have another parent.
    reached = edges.where(F.col("src") == ABOVE).unionByName(edges.join(jumps.depths("src"), ["graph_id", "src"], "left_semi"))
    joins = reached.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id", "dst")
    hard = checkpoint(reached.join(joins, ["graph_id", "dst"]).select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("b")))
    settled, stored = [], []
    while True:
        pairs = hard.join(parents.select(*KEY, F.col("parent").alias("a")), KEY).withColumn("old", F.col("a"))
        # Where the parent is above the node that leads here, nothing moves.
        apart = checkpoint(jumps.leveled(pairs).where("a <> b or a <> old"))
        if apart.isEmpty():
            break
        # A graph in which no parent moves is done; the next rounds leave it out.
        moving = checkpoint(apart.select("graph_id").distinct())
        best = jumps.met(apart).groupBy(*KEY).agg(F.min_by("lca", "level").alias("new"))
        now = parents.join(best, KEY, "left").join(moving.withColumn("moves", F.lit(True)), "graph_id", "left")
        now = checkpoint(now.select(*KEY, F.coalesce("new", "parent").alias("parent"), F.coalesce("moves", F.lit(False)).alias("moves")))
        last, hard = hard, checkpoint(hard.join(moving, "graph_id", "left_semi"))
        jumps.discard()
        discard(last, apart, moving)
        stored.append(now)
        settled.append(now.where("not moves").select(*KEY, "parent"))
        parents = now.where("moves").select(*KEY, "parent")
        jumps = Jumps(parents)
    discard(apart, hard, edges)
    if any(not part.isEmpty() for part in settled):
        for part in settled:
            parents = parents.unionByName(part)
        parents = checkpoint(parents)
        jumps.discard()
        discard(*stored)
        jumps = Jumps(parents)
    return parents, jumps


def immediate_dominators(graph: Graph, roots: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, idom, depth) of the nodes that a root reaches; null and depth 0 at a root."""
    parents, jumps = parents_and_jumps(graph, roots)
    tree = parents.join(jumps.depths(), KEY)
    return checkpoint(tree.select(*KEY, F.when(F.col("parent") != ABOVE, F.col("parent")).alias("idom"), (F.col("depth") - 1).alias("depth")))


def tree_jumps(tree: DataFrame) -> Jumps:
    """The jump tables of a tree of ``immediate_dominators``."""
    return Jumps(tree.select(*KEY, F.coalesce("idom", F.lit(ABOVE)).alias("parent")))


def dominates(jumps: Jumps, pairs: DataFrame, above: str, below: str) -> DataFrame:
    """The (graph_id, above, below, ...) rows whose one node dominates the other, or is the same."""
    columns: Sequence[Column] = [F.col(c) for c in pairs.columns]
    rows = pairs.join(jumps.depths(above, "__da"), ["graph_id", above]).join(jumps.depths(below, "__db"), ["graph_id", below]).where("__db >= __da")
    rows = rows.withColumn("__at", F.col(below)).withColumn("__by", F.col("__db") - F.col("__da"))
    return jumps.lifted(rows, "__at", "__by").where(F.col("__at") == F.col(above)).select(*columns)


# -- changed graphs ---------------------------------------------------------------


def affected_roots(tree: DataFrame, jumps: Jumps, graph: Graph, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The region that changes of edges can alter, for ``tree`` of the graph before and ``graph`` after them.

    Returns (graph_id, z), of which only nodes strictly below can have another dominator,
    and (graph_id, node_id), the nodes that are reached now and were not before.

    An added edge from a reached node to another matters only where the nearest common
    dominator of its ends does not dominate the target at once; that one is z. Where
    the target was not reached, what it reaches now is new, and every edge from there into
    reached nodes counts as one from the source. A removed edge matters below the
    immediate dominator of its target. Several changes count below the common
    dominator of their own.
    """
    known = tree.select(*KEY)
    at = lambda name: known.withColumnRenamed("node_id", name)
    into = added.select("graph_id", "src", "dst").where("src <> dst").distinct().join(at("src"), ["graph_id", "src"], "left_semi")
    fresh = checkpoint(into.join(at("dst"), ["graph_id", "dst"], "left_anti"))
    edges = graph.live().select("graph_id", "src", "dst").distinct()
    step = lambda f: f.join(edges.withColumnRenamed("src", "node_id"), KEY).select("graph_id", F.col("dst").alias("node_id"), "from").join(known, KEY, "left_anti")
    found = fresh.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("from"))
    new = found if fresh.isEmpty() else closure(found, step, [*KEY, "from"])
    back = new.join(edges.withColumnRenamed("src", "node_id"), KEY).join(at("dst"), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("from").alias("src"), "dst")
    pairs = into.join(at("dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst").unionByName(back).distinct()
    pairs = pairs.join(tree.select("graph_id", F.col("node_id").alias("dst"), F.col("idom").alias("old")), ["graph_id", "dst"])
    common = jumps.common(pairs.select("graph_id", "dst", "old", F.col("src").alias("a"), F.col("dst").alias("b")))
    tops = common.where("lca <> dst and not (lca <=> old)").select("graph_id", F.col("lca").alias("z"))
    tops = tops.unionByName(fresh.select("graph_id", F.col("src").alias("z")))
    gone = removed.select("graph_id", "src", "dst").where("src <> dst").distinct().join(edges, ["graph_id", "src", "dst"], "left_anti").join(at("src"), ["graph_id", "src"], "left_semi")
    tops = tops.unionByName(gone.join(tree.select("graph_id", F.col("node_id").alias("dst"), F.col("idom").alias("z")), ["graph_id", "dst"]).where("z is not null").select("graph_id", "z"))
    return _one_above(jumps, tops), checkpoint(new.select(*KEY).distinct())


def _one_above(jumps: Jumps, tops: DataFrame) -> DataFrame:
    """(graph_id, z): the common ancestor of all (graph_id, z) of a graph.

    The common ancestors of one of them with each lie on one path, so the highest of these is above all.
    """
    one = tops.groupBy("graph_id").agg(F.min("z").alias("b"))
    met = jumps.common(tops.distinct().join(one, "graph_id").select("graph_id", F.col("z").alias("a"), "b"))
    return checkpoint(met.groupBy("graph_id").agg(F.min_by("lca", "level").alias("z")))


def updated_dominators(tree: DataFrame, graph: Graph, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dominator tree of ``graph``, in which (graph_id, src, dst) edges were added and removed since ``tree`` was made.

    Only the nodes strictly below the nearest dominator common to the changes are
    computed again, in the graph that they and that dominator span. Returns the new tree
    and (graph_id, node_id), the nodes that were computed.
    """
    jumps = tree_jumps(tree)
    tops, new = affected_roots(tree, jumps, graph, added, removed)
    if tops.isEmpty():
        return tree, new
    edges = graph.live()
    while True:
        pairs = tree.select(*KEY).join(tops, "graph_id")
        below = dominates(jumps, pairs, "z", "node_id").where("node_id <> z").unionByName(pairs.where(F.col("z") == ABOVE))
        region = checkpoint(below.select(*KEY).unionByName(new.select(*KEY)))
        heads = tops.where(F.col("z") != ABOVE).select("graph_id", F.col("z").alias("root"))
        if graph.roots is not None:  # where only the node above all roots is common, they are computed again with all
            heads = heads.unionByName(graph.roots.join(tops.where(F.col("z") == ABOVE), "graph_id", "left_semi").select("graph_id", "root"))
        inside = checkpoint(region.unionByName(heads.select("graph_id", F.col("root").alias("node_id"))).distinct())
        both = edges.join(inside.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(region.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
        sub = immediate_dominators(Graph(inside.withColumn("payload", F.lit(None).cast("string")), both.select(*edges.columns), heads))
        # What is not reached any more may have led to nodes beyond the region, which then change, too.
        lost = region.join(sub.select(*KEY), KEY, "left_anti").join(tree.select(*KEY), KEY, "left_semi")
        was = graph.edges.join(lost.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", "dst").distinct()
        beyond = was.join(tree.select("graph_id", F.col("node_id").alias("dst"), F.col("idom").alias("z")), ["graph_id", "dst"]).join(inside.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti")
        more = checkpoint(beyond.where("z is not null").select("graph_id", "z"))
        if more.isEmpty():
            break
        tops = _one_above(jumps, tops.unionByName(more))
    depth = tops.join(tree.select("graph_id", F.col("node_id").alias("z"), F.col("depth").alias("top")), ["graph_id", "z"], "left")
    changed = sub.join(depth, "graph_id").where("node_id <> z").select(*KEY, "idom", (F.col("depth") + F.coalesce("top", F.lit(0))).alias("depth"))
    kept = tree.join(region, KEY, "left_anti").select(*KEY, "idom", "depth")
    return checkpoint(kept.unionByName(changed)), region
