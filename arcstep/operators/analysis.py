"""Metrics, patterns, profiles, purity, calls, aliases, diffs and checks of stored graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.components import weak_components
from arcstep.operators.dominance import nesting_depth
from arcstep.operators.graph import Graph
from arcstep.operators.traverse import reachable

KEY = ["graph_id", "node_id"]


def graph_metrics(graph: Graph, bodies: DataFrame, instrs: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, reachable nodes, exits, cyclomatic number of the reachable part, greatest loop nesting.

    With instructions, their number as well.
    """
    live = reachable(graph, graph.roots.select("graph_id", F.col("root").alias("node_id")))
    inside = graph.live().join(live.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    n = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    deep = nesting_depth(graph, bodies).groupBy("graph_id").agg(F.max("depth").alias("max_nesting"))
    out = graph.node_count()
    parts = [graph.edge_count(), n(live, "reachable"), n(inside, "inner"), n(graph.exits(), "exits"), deep]
    if instrs is not None:
        parts.append(n(instrs, "instructions"))
    for p in parts:
        out = out.join(p, "graph_id", "left")
    out = out.fillna(0)
    cyclomatic = F.when(F.col("inner") < F.col("reachable"), 1).otherwise(F.col("inner") - F.col("reachable") + 2)
    return out.withColumn("cyclomatic", cyclomatic.cast("long")).withColumn("unreachable", F.col("nodes") - F.col("reachable")).drop("inner")


def self_loops(graph: Graph) -> DataFrame:
    """(graph_id, node_id) with a self edge."""
    return graph.live().where("src = dst").select("graph_id", F.col("src").alias("node_id")).distinct()


def diamonds(graph: Graph) -> DataFrame:
    """(graph_id, top, left, right, bottom): two out-edges to arms whose single out-edges meet; equal arms count."""
    r = graph.ranked()
    degree = r.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n"))
    two = r.join(degree.where("n = 2"), ["graph_id", "src"])
    one = r.join(degree.where("n = 1"), ["graph_id", "src"]).select("graph_id", F.col("src").alias("arm"), F.col("dst").alias("bottom"))
    arm = lambda k, name: two.where(f"out_rank = {k}").select("graph_id", F.col("src").alias("top"), F.col("dst").alias(name))
    both = arm(0, "left").join(arm(1, "right"), ["graph_id", "top"])
    both = both.join(one.withColumnRenamed("arm", "left"), ["graph_id", "left"]).join(one.select("graph_id", F.col("arm").alias("right"), F.col("bottom").alias("b2")), ["graph_id", "right"])
    return both.where("bottom = b2").select("graph_id", "top", "left", "right", "bottom")


def chains(graph: Graph) -> DataFrame:
    """(graph_id, head, length): runs of two nodes or more joined by the only out-edge of one and the only in-edge of the next."""
    e = graph.live()
    out1 = e.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("graph_id", "src")
    in1 = e.groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("graph_id", "dst")
    links = e.join(out1, ["graph_id", "src"], "left_semi").join(in1, ["graph_id", "dst"], "left_semi").where("src <> dst")
    comp = weak_components(links.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")))
    heads = links.select("graph_id", F.col("src").alias("node")).distinct().join(links.select("graph_id", F.col("dst").alias("node")), ["graph_id", "node"], "left_anti")
    sized = comp.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("length"))
    # A ring of such links has no head and is not a chain.
    return comp.join(heads, ["graph_id", "node"]).join(sized, ["graph_id", "component"]).select("graph_id", F.col("node").alias("head"), "length")


def trampolines(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, node_id): blocks without instructions and with one out-edge."""
    one = graph.live().groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*KEY)
    return one.join(instrs.select("graph_id", F.col("block").alias("node_id")), KEY, "left_anti")


# -- profiles --------------------------------------------------------------------


def uniform_weights(graph: Graph) -> Graph:
    """Every edge gets one divided by its source's out-degree."""
    n = F.count(F.when(F.col("live"), 1)).over(W.partitionBy("graph_id", "src"))
    return Graph(graph.nodes, graph.edges.withColumn("weight", F.lit(1.0) / n), graph.roots)


def block_weights(graph: Graph) -> DataFrame:
    """(graph_id, node_id, weight): sums of incoming weights where positive; a root weighs 1."""
    into = graph.live().groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("weight").alias("weight")).where("weight > 0")
    roots = graph.roots.select("graph_id", F.col("root").alias("node_id"), F.lit(1.0).alias("weight"))
    return into.join(roots.select(*KEY), KEY, "left_anti").unionByName(roots)


def hottest(weights: DataFrame) -> DataFrame:
    """(graph_id, node_id, weight): greatest weight, ties to the last node."""
    m = weights.groupBy("graph_id").agg(F.max(F.struct("weight", "node_id")).alias("m"))
    return m.select("graph_id", "m.node_id", "m.weight")


def coldest(weights: DataFrame) -> DataFrame:
    """(graph_id, node_id, weight): least weight, ties to the first node."""
    m = weights.groupBy("graph_id").agg(F.min(F.struct("weight", "node_id")).alias("m"))
    return m.select("graph_id", "m.node_id", "m.weight")


def hot_blocks(weights: DataFrame, threshold: float) -> DataFrame:
    return weights.where(F.col("weight") >= threshold)


# -- instructions ------------------------------------------------------------------


def block_purity(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, node_id, effects, pure): distinct sorted effects of every block, empty ones included."""
    found = instrs.select("graph_id", F.col("block").alias("node_id"), F.explode("effects").alias("e")).groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("e")), ",").alias("effects"))
    return graph.nodes.select(*KEY).join(found, KEY, "left").fillna("", ["effects"]).withColumn("pure", F.col("effects") == "")


def graph_purity(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, effects, pure) of whole graphs."""
    found = instrs.select("graph_id", F.explode("effects").alias("e")).groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_set("e")), ",").alias("effects"))
    return graph.nodes.select("graph_id").distinct().join(found, "graph_id", "left").fillna("", ["effects"]).withColumn("pure", F.col("effects") == "")


def tail_calls(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, block, idx): a block's last instruction is a call, and its only successor, if any, is an exit."""
    last = instrs.groupBy("graph_id", "block").agg(F.max_by(F.struct("idx", "effect"), "idx").alias("l")).where("l.effect in ('Call', 'ConditionalCall')")
    succ = graph.live().groupBy("graph_id", F.col("src").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("node_id"))
    exits = graph.exits().withColumn("is_exit", F.lit(True))
    joined = last.join(succ, ["graph_id", "block"]).where("n = 1").join(exits, KEY, "left_semi")
    return joined.select("graph_id", "block", F.col("l.idx").alias("idx"))


def alias_pairs(instrs: DataFrame) -> DataFrame:
    """(graph_id, a, b): variables that one memory access makes share a place.

    ``instrs`` has uses, defs, memory (the bases accessed, in order) and stores (those
    stored to). Bases of one instruction go with its first one, stored ones with what
    the instruction defines. Every variable goes with itself.
    """
    own = instrs.select("graph_id", F.explode(F.array_union("uses", "defs")).alias("a")).select("graph_id", "a", F.col("a").alias("b"))
    together = instrs.where("size(memory) > 1").select("graph_id", F.col("memory")[0].alias("a"), F.explode("memory").alias("b"))
    stored = instrs.select("graph_id", "defs", F.explode("stores").alias("a")).select("graph_id", "a", F.explode("defs").alias("b"))
    return own.union(together).union(stored).distinct()


def alias_sets(pairs: DataFrame) -> DataFrame:
    """(graph_id, node, component): variables unified by (graph_id, a, b) rows; further rows merge sets; a set is named by its least variable."""
    return weak_components(pairs)


def may_alias(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, a, b, alias) of the asked pairs; unknown variables share nothing."""
    side = lambda c, n: sets.select("graph_id", F.col("node").alias(c), F.col("component").alias(n))
    joined = pairs.join(side("a", "ca"), ["graph_id", "a"], "left").join(side("b", "cb"), ["graph_id", "b"], "left")
    return joined.select("graph_id", "a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("alias"))


def alias_set_count(sets: DataFrame) -> DataFrame:
    """(graph_id, sets)."""
    return sets.groupBy("graph_id").agg(F.count_distinct("component").alias("sets"))


def fingerprints(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, node_id, fingerprint): instruction count, degrees, and sorted kinds of the out-edges."""
    e = graph.live()
    n = lambda df, k, name: df.groupBy("graph_id", F.col(k).alias("node_id")).agg(F.count(F.lit(1)).alias(name))
    kinds = e.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("kind")), "+").alias("kinds"))
    out = graph.nodes.select(*KEY)
    for p in (n(instrs, "block", "i"), n(e, "src", "o"), n(e, "dst", "d"), kinds):
        out = out.join(p, KEY, "left")
    out = out.fillna(0, ["i", "o", "d"]).fillna("", ["kinds"])
    return out.select(*KEY, F.concat_ws(":", F.col("i").cast("string"), F.col("o").cast("string"), F.col("d").cast("string"), "kinds").alias("fingerprint"))


def graph_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, matched, only_left, only_right, ratio) from fingerprints (pair, node_id, fingerprint) of both sides.

    Equal fingerprints are matched one to one in node order; the ratio is matched
    over the larger side's count, 1 where both are empty.
    """
    w = W.partitionBy("pair", "fingerprint").orderBy("node_id")
    number = lambda df, n: df.select("pair", "fingerprint", F.row_number().over(w).alias("k"), F.lit(1).alias(n))
    both = number(left, "l").join(number(right, "r"), ["pair", "fingerprint", "k"], "full")
    total = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1)), F.lit(0)).cast("long")
    out = both.groupBy("pair").agg(total("l = 1 and r = 1").alias("matched"), total("l = 1 and r is null").alias("only_left"), total("l is null and r = 1").alias("only_right"))
    most = F.col("matched") + F.greatest("only_left", "only_right")
    return out.withColumn("ratio", F.when(most == 0, 1.0).otherwise(F.round(F.col("matched") / most, 6)))


def verify(graph: Graph) -> DataFrame:
    """(graph_id, violation, node_id): roots that are no node, edge ends that are none, reachable non-root nodes without an in-edge."""
    nodes = graph.nodes.select(*KEY)
    bad = lambda df, name: df.select("graph_id", F.lit(name).alias("violation"), "node_id")
    roots = graph.roots.select("graph_id", F.col("root").alias("node_id"))
    ends = graph.live().select("graph_id", F.col("src").alias("node_id")).unionByName(graph.live().select("graph_id", F.col("dst").alias("node_id"))).distinct()
    live = reachable(graph, roots)
    into = graph.live().select("graph_id", F.col("dst").alias("node_id"))
    lost = live.join(roots, KEY, "left_anti").join(into, KEY, "left_anti")
    return bad(roots.join(nodes, KEY, "left_anti"), "root").unionByName(bad(ends.join(nodes, KEY, "left_anti"), "edge end")).unionByName(bad(lost, "no in-edge"))


def interference(instrs: DataFrame, live: DataFrame) -> DataFrame:
    """(graph_id, a, b), a < b: variables that are live out of one block together, or defined there while the other is."""
    out = live.where("side = 'out'").select("graph_id", "block", "variable")
    both = out.unionByName(instrs.select("graph_id", "block", F.explode("defs").alias("variable"))).distinct()
    other = out.select("graph_id", "block", F.col("variable").alias("other"))
    pairs = both.join(other, ["graph_id", "block"]).where("variable <> other")
    return pairs.select("graph_id", F.least("variable", "other").alias("a"), F.greatest("variable", "other").alias("b")).distinct()


#: Points of a block that share a bin when live ranges are compared.
BIN = 64
#: Consecutive blocks of a graph whose pairs of variables are found in one task.
BLOCKS = 256


def live_ranges(instrs: DataFrame, live: DataFrame) -> DataFrame:
    """(graph_id, block, variable, first, last): ranges of points of a block at which a variable holds a value that is used, or was just written.

    Point i lies behind instruction i, point -1 before the first one. Going backward from the
    variables live out of the block, a variable is live up to its next event there if that is a
    use; an instruction reads before it writes.
    """
    key = ["graph_id", "block", "variable"]
    reads = instrs.select("graph_id", "block", "idx", F.explode("uses").alias("variable"), F.lit(0).alias("write"))
    writes = instrs.select("graph_id", "block", "idx", F.explode("defs").alias("variable"), F.lit(1).alias("write"))
    size = instrs.groupBy("graph_id", "block").agg(F.max("idx").alias("end"))
    out = live.where("side = 'out'").select(*key).join(size, ["graph_id", "block"], "left").select(*key, F.coalesce(F.col("end") + 1, F.lit(0)).alias("idx"), F.lit(0).alias("write"))
    events = reads.unionByName(writes).unionByName(out).distinct()  # what is live out is read behind the block
    order = W.partitionBy(*key).orderBy("idx", "write")
    events = events.withColumn("before", F.lag("idx").over(order)).withColumn("was", F.lag("write").over(order))
    used = events.where("write = 0").select(*key, F.coalesce("before", F.lit(-1)).alias("first"), (F.col("idx") - 1).alias("last"))
    # A value is read in the instruction that writes the variable anew: nothing is held at the point between.
    held = used.where("first <= last")
    written = events.where("write = 1").select(*key, F.col("idx").alias("first"), F.col("idx").alias("last"))
    return held.unionByName(written).distinct()


def interference_at_points(instrs: DataFrame, live: DataFrame) -> DataFrame:
    """(graph_id, a, b), a < b: variables that hold values at one point of a block, as ``live_ranges`` has them.

    Ranges meet over bins of points, so that of a long block only ranges near each other are compared.
    """
    ranges = live_ranges(instrs, live)
    binned = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor(F.col("last") / BIN))))
    # Neighbouring blocks mostly hold the same pairs: a task that has several of them drops the repeats before they move.
    key = ["graph_id", "part", "block", "bin"]
    binned = binned.withColumn("part", F.floor(F.col("block") / BLOCKS)).repartition("graph_id", "part")
    near = binned.groupBy(*key).agg(F.collect_list(F.struct("variable", "first", "last")).alias("ranges")).select("graph_id", "ranges", F.explode("ranges").alias("one"))
    meets = lambda x: (x["variable"] > F.col("one.variable")) & (x["first"] <= F.col("one.last")) & (x["last"] >= F.col("one.first"))
    others = F.transform(F.filter("ranges", meets), lambda x: x["variable"])
    return near.select("graph_id", F.col("one.variable").alias("a"), F.explode(others).alias("b")).distinct()


def colour(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, colour): greedy colouring by ascending degree, then name; each takes the least free colour.

    Nodes whose earlier neighbours all have colours are coloured together, which
    gives the sequential greedy result.
    """
    from arcstep.operators.frames import checkpoint

    both = pairs.select("graph_id", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select("graph_id", F.col("b").alias("node"), F.col("a").alias("other")))
    degree = nodes.join(both.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("d")), ["graph_id", "node"], "left").fillna(0, ["d"])
    pri = lambda n: degree.select("graph_id", F.col("node").alias(n), F.struct("d", "node").alias(f"p_{n}"))
    earlier = checkpoint(both.join(pri("node"), ["graph_id", "node"]).join(pri("other"), ["graph_id", "other"]).where("p_other < p_node").select("graph_id", "node", "other"))
    left = checkpoint(nodes.select("graph_id", "node"))
    done = checkpoint(left.withColumn("colour", F.lit(0).cast("long")).limit(0))
    while not left.isEmpty():
        seen = earlier.join(left, ["graph_id", "node"], "left_semi").join(done.select("graph_id", F.col("node").alias("other"), "colour"), ["graph_id", "other"], "left")
        state = seen.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("n"), F.count("colour").alias("k"), F.collect_set("colour").alias("taken"))
        ready = left.join(state, ["graph_id", "node"], "left").where("n is null or n = k")
        free = F.expr("cast(array_min(array_except(sequence(0, coalesce(size(taken), 0)), transform(coalesce(taken, array()), x -> cast(x as int)))) as bigint)")
        new = checkpoint(ready.select("graph_id", "node", free.alias("colour")))
        done = checkpoint(done.unionByName(new))
        left = checkpoint(left.join(new, ["graph_id", "node"], "left_anti"))
    return done
