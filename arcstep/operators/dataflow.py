"""Dataflow over blocks of instructions: reaching definitions, liveness, def-use, SSA, constants, lattices.

Instructions are rows (graph_id, block, idx, uses, defs, ...). Facts are rows,
too, so a fixpoint over sets is a closure over (fact, block) pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.components import weak_components
from arcstep.operators.dominance import dominance_frontier
from arcstep.operators.frames import HOPS, checkpoint, closure, dealt, digest, discard
from arcstep.operators.graph import Graph

BLOCK = ["graph_id", "block"]


def definitions(instrs: DataFrame) -> DataFrame:
    """(graph_id, block, idx, variable) of every definition."""
    return instrs.select("graph_id", "block", "idx", F.explode("defs").alias("variable"))


def uses(instrs: DataFrame) -> DataFrame:
    return instrs.select("graph_id", "block", "idx", F.explode("uses").alias("variable"))


def _edges(graph: Graph) -> DataFrame:
    return graph.live().select("graph_id", F.col("src").alias("block"), F.col("dst").alias("next")).distinct()


def reaching_definitions(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, side, block, def_block, def_idx, variable), side in or out.

    The last definition of a variable in a block leaves it; it passes on through
    blocks that do not define the variable.
    """
    defs = definitions(instrs)
    last = defs.groupBy("graph_id", "block", "variable").agg(F.max("idx").alias("def_idx"))
    kills = dealt(last.select("graph_id", F.col("block").alias("next"), "variable"), ["graph_id", "next", "variable"])
    edges = dealt(_edges(graph), BLOCK)
    key = ["graph_id", "block", "def_block", "def_idx", "variable"]
    seeds = last.select("graph_id", "block", F.col("block").alias("def_block"), "def_idx", "variable")

    def step(f: DataFrame) -> DataFrame:
        moved = f.join(edges, BLOCK).join(kills, ["graph_id", "next", "variable"], "left_anti")
        return moved.select("graph_id", F.col("next").alias("block"), "def_block", "def_idx", "variable")

    out = checkpoint(closure(seeds, step, key).select(*key))
    into = out.join(edges, BLOCK).select("graph_id", F.col("next").alias("block"), *key[2:]).distinct()
    return into.withColumn("side", F.lit("in")).unionByName(out.withColumn("side", F.lit("out")))


def liveness(graph: Graph, instrs: DataFrame) -> DataFrame:
    """(graph_id, side, block, variable), side in or out: variables whose value may still be used."""
    first_use = uses(instrs).groupBy("graph_id", "block", "variable").agg(F.min("idx").alias("u"))
    first_def = definitions(instrs).groupBy("graph_id", "block", "variable").agg(F.min("idx").alias("d"))
    exposed = first_use.join(first_def, ["graph_id", "block", "variable"], "left").where("d is null or u <= d")
    kills = dealt(first_def.select("graph_id", F.col("block").alias("prev"), "variable"), ["graph_id", "prev", "variable"])
    turned = dealt(_edges(graph).select("graph_id", F.col("block").alias("prev"), F.col("next").alias("block")), BLOCK)
    key = ["graph_id", "block", "variable"]

    def step(f: DataFrame) -> DataFrame:
        return f.join(turned, BLOCK).join(kills, ["graph_id", "prev", "variable"], "left_anti").select("graph_id", F.col("prev").alias("block"), "variable")

    into = checkpoint(closure(exposed.select(*key), step, key).select(*key))
    out = into.join(turned, BLOCK).select("graph_id", F.col("prev").alias("block"), "variable").distinct()
    return into.withColumn("side", F.lit("in")).unionByName(out.withColumn("side", F.lit("out")))


def all_live_variables(live: DataFrame) -> DataFrame:
    """(graph_id, variable): variables live at some block's entry or exit."""
    return live.select("graph_id", "variable").distinct()


def def_use(instrs: DataFrame, reaching: DataFrame) -> DataFrame:
    """(graph_id, variable, def_block, def_idx, use_block, use_idx): a use reads the block's last earlier definition, else all reaching ones."""
    marks = definitions(instrs).withColumn("is_def", F.lit(1)).unionByName(uses(instrs).withColumn("is_def", F.lit(0)))
    w = W.partitionBy("graph_id", "block", "variable").orderBy("idx").rangeBetween(W.unboundedPreceding, -1)
    local = marks.withColumn("own", F.max(F.when(F.col("is_def") == 1, F.col("idx"))).over(w)).where("is_def = 0")
    inside = local.where("own is not null").select("graph_id", "variable", F.col("block").alias("def_block"), F.col("own").alias("def_idx"), F.col("block").alias("use_block"), F.col("idx").alias("use_idx"))
    outside = local.where("own is null").join(reaching.where("side = 'in'"), ["graph_id", "block", "variable"]).select(
        "graph_id", "variable", "def_block", "def_idx", F.col("block").alias("use_block"), F.col("idx").alias("use_idx")
    )
    return inside.unionByName(outside).distinct()


def dead_definitions(instrs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, block, idx, variable) of definitions that no use reads."""
    used = pairs.select("graph_id", F.col("def_block").alias("block"), F.col("def_idx").alias("idx"), "variable")
    return definitions(instrs).distinct().join(used, ["graph_id", "block", "idx", "variable"], "left_anti")


def program_dependence(pairs: DataFrame, control: DataFrame, instrs: DataFrame) -> DataFrame:
    """(graph_id, kind, src_block, src_idx, dst_block, dst_idx): data edges between instructions, control edges to blocks.

    A null dst_idx is the block's predicate, controlled by the controller's last instruction.
    """
    data = pairs.select("graph_id", F.lit("Data").alias("kind"), F.col("def_block").alias("src_block"), F.col("def_idx").alias("src_idx"), F.col("use_block").alias("dst_block"), F.col("use_idx").alias("dst_idx"))
    last = instrs.groupBy("graph_id", "block").agg(F.max("idx").alias("src_idx"))
    ctl = control.select("graph_id", F.col("controller").alias("block"), F.col("dependent").alias("dst_block")).join(last, BLOCK)
    ctl = ctl.select("graph_id", F.lit("Control").alias("kind"), F.col("block").alias("src_block"), "src_idx", "dst_block", F.lit(None).cast("long").alias("dst_idx"))
    return data.unionByName(ctl).distinct()


# -- static single assignment ---------------------------------------------------


def place_phis(graph: Graph, instrs: DataFrame, dom: DataFrame) -> DataFrame:
    """(graph_id, block, variable): joins in the iterated dominance frontier of a variable's definitions; not pruned."""
    frontier = checkpoint(dominance_frontier(graph, dom).withColumnRenamed("node_id", "block"))
    start = definitions(instrs).select("graph_id", "block", "variable").distinct()
    step = lambda f: f.join(frontier, BLOCK).select("graph_id", F.col("frontier").alias("block"), "variable")
    reached = closure(step(start), step, ["graph_id", "block", "variable"])
    return reached.select("graph_id", "block", "variable")


def ssa_definitions(instrs: DataFrame, phis: DataFrame, dom: DataFrame) -> DataFrame:
    """(graph_id, variable, block, idx, is_phi, version): versions count up in dominator-tree preorder from 1.

    The preorder with children in id order is the order of root-to-node paths,
    blocks that the root does not reach following by id. Phis come before
    instructions, and version 0 is the value at entry.
    """
    path = dom_paths(dom)
    marks = phis.select("graph_id", "block", F.lit(-1).cast("long").alias("idx"), "variable", F.lit(True).alias("is_phi")).unionByName(
        definitions(instrs).withColumn("is_phi", F.lit(False))
    )
    marks = marks.join(path, BLOCK, "left").withColumn("unreached", F.col("path").isNull())
    order = W.partitionBy("graph_id", "variable").orderBy("unreached", "path", "block", "idx")
    return marks.withColumn("version", F.row_number().over(order).cast("long")).select("graph_id", "variable", "block", "idx", "is_phi", "version")


def dom_paths(dom: DataFrame) -> DataFrame:
    """(graph_id, block, path): a node's dominators from the root down, an array that sorts in preorder."""
    depth = dom.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("d"))
    steps = dom.join(depth.select("graph_id", F.col("node_id").alias("dom"), "d"), ["graph_id", "dom"])
    paths = steps.groupBy("graph_id", F.col("node_id").alias("block")).agg(F.array_sort(F.collect_list(F.struct("d", "dom"))).alias("p"))
    return paths.select("graph_id", "block", F.col("p.dom").alias("path"))


def ssa_uses(instrs: DataFrame, defs: DataFrame, dom: DataFrame) -> DataFrame:
    """(graph_id, block, idx, variable, version): a use reads the nearest definition that dominates it, else version 0."""
    reads = uses(instrs).distinct()
    return _nearest(reads, defs, dom, ["graph_id", "block", "idx", "variable"], before=True)


def _nearest(reads: DataFrame, defs: DataFrame, dom: DataFrame, key: list[str], before: bool) -> DataFrame:
    depth = dom.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("depth"))
    above = dom.join(depth.select("graph_id", F.col("node_id").alias("dom"), "depth"), ["graph_id", "dom"]).select("graph_id", F.col("node_id").alias("block"), F.col("dom").alias("at"), "depth")
    d = defs.select("graph_id", "variable", F.col("block").alias("at"), F.col("idx").alias("def_idx"), "version")
    found = reads.join(above, BLOCK).join(d, ["graph_id", "variable", "at"])
    if before:
        found = found.where("at <> block or def_idx < idx")
    best = found.groupBy(*key).agg(F.max(F.struct("depth", "def_idx", "version")).alias("m"))
    return reads.join(best, key, "left").select(*key, F.coalesce("m.version", F.lit(0)).cast("long").alias("version"))


def phi_operands(graph: Graph, phis: DataFrame, defs: DataFrame, dom: DataFrame) -> DataFrame:
    """(graph_id, block, variable, edge_id, pred, version): a phi's operand for each in-edge, parallel ones kept."""
    edges = graph.live().select("graph_id", "edge_id", F.col("src").alias("pred"), F.col("dst").alias("to"))
    reads = phis.select("graph_id", F.col("block").alias("to"), "variable").join(edges, ["graph_id", "to"]).withColumn("block", F.col("pred"))
    out = _nearest(reads.select("graph_id", "block", "to", "variable", "edge_id", "pred"), defs, dom, ["graph_id", "block", "to", "variable", "edge_id", "pred"], before=False)
    return out.select("graph_id", F.col("to").alias("block"), "variable", "edge_id", "pred", "version")


def phi_copies(defs: DataFrame, operands: DataFrame) -> DataFrame:
    """(graph_id, pred, variable, to_version, from_version): a copy for each phi operand, at the end of its predecessor."""
    target = defs.where("is_phi").select("graph_id", "block", "variable", F.col("version").alias("to_version"))
    return operands.join(target, ["graph_id", "block", "variable"]).select("graph_id", "pred", "variable", "to_version", F.col("version").alias("from_version"))


def phi_webs(copies: DataFrame) -> DataFrame:
    """(graph_id, variable, version, web): versions that phis connect; a web is named by its least version."""
    pairs = copies.select("graph_id", "variable", F.col("to_version").alias("a"), F.col("from_version").alias("b"))
    webs = weak_components(pairs, ["graph_id", "variable"])
    return webs.select("graph_id", "variable", F.col("node").alias("version"), F.col("component").alias("web"))


def memory_ssa(graph: Graph, instrs: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions of memory: the accesses (graph_id, block, idx, memory, access, version), and the operands of the phis.

    ``instrs`` has (graph_id, block, idx, reads, writes), arrays of names of memories such as alias
    sets; one name for all is memory as a whole. A write makes a version (access ``def``), a read
    has the version that the last write before it on every path left (``use``), joins of different
    versions make one at idx -1 (``phi``), and version 0 is memory at entry. A write follows the version
    before it, which is its ``clobbered`` one. The operands (graph_id, block, memory, edge_id, pred, version) name
    the version that comes over each edge into a phi.
    """
    own = checkpoint(instrs.select("graph_id", "block", "idx", F.col("reads").alias("uses"), F.col("writes").alias("defs")))
    phis = checkpoint(place_phis(graph, own, dom))
    defs = checkpoint(ssa_definitions(own, phis, dom))
    read = ssa_uses(own, defs, dom).withColumn("access", F.lit("use")).withColumn("clobbered", F.lit(None).cast("long"))
    # What a write finds is what a read at its place would have.
    found = ssa_uses(own.withColumn("uses", F.col("defs")), defs, dom).select("graph_id", "block", "idx", "variable", F.col("version").alias("clobbered"))
    made = defs.withColumn("access", F.when(F.col("is_phi"), "phi").otherwise("def")).join(found, ["graph_id", "block", "idx", "variable"], "left")
    columns = ["graph_id", "block", "idx", F.col("variable").alias("memory"), "access", "version", "clobbered"]
    operands = phi_operands(graph, phis, defs, dom).withColumnRenamed("variable", "memory")
    return made.select(*columns).unionByName(read.select(*columns)), operands


# -- lattices -------------------------------------------------------------------


def solve(graph: Graph, own: DataFrame, meet: Callable[[str], Column], transfer: Callable[[Column, Column], Column], bottom: Column, direction: str = "forward") -> DataFrame:
    """(graph_id, node_id, fact_in, fact_out): a fixpoint of one scalar fact a node over all graphs at once.

    ``own`` has (graph_id, node_id, own): a node's own parameter. ``meet`` names an
    aggregate over the neighbours' out facts; ``transfer`` maps (met, own) to the
    out fact. Nodes without neighbours meet ``bottom``. Meet and transfer must be
    monotone.
    """
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    edges = checkpoint(graph.live().select("graph_id", F.col(a).alias("node_id"), F.col(b).alias("to")).distinct())
    own = checkpoint(own)
    key = ["graph_id", "node_id"]
    facts = checkpoint(own.select(*key, bottom.alias("fact_in"), transfer(bottom, F.col("own")).alias("fact_out")))
    before = None
    while (now := digest(facts, [*key, "fact_in", "fact_out"])) != before:
        before, last = now, facts
        # Facts only rise, so they are at rest if several steps together move nothing; edges are moved once for these.
        for _ in range(HOPS):
            met = facts.join(edges, key).groupBy("graph_id", F.col("to").alias("node_id")).agg(meet("fact_out").alias("met"))
            joined = own.join(met, key, "left").withColumn("fact_in", F.coalesce("met", bottom))
            facts = joined.select(*key, "fact_in", transfer(F.col("fact_in"), F.col("own")).alias("fact_out"))
        facts = checkpoint(facts)
        discard(last)
    return facts


def constants(graph: Graph, instrs: DataFrame, constant: str = "value") -> DataFrame:
    """(graph_id, block, variable, state, value) at block entry.

    The last definition of a variable in a block gives its constant. At a join
    equal constants stay, different ones become BOTTOM, and a path that does not
    define the variable does not count.
    """
    reach = reaching_definitions(graph, instrs).where("side = 'in'")
    values = instrs.select("graph_id", F.col("block").alias("def_block"), F.col("idx").alias("def_idx"), F.col(constant).alias("value"))
    met = reach.join(values, ["graph_id", "def_block", "def_idx"]).groupBy("graph_id", "block", "variable").agg(
        F.count_distinct("value").alias("k"), F.min("value").alias("value"), F.count("value").alias("known"), F.count(F.lit(1)).alias("n")
    )
    one = (F.col("k") == 1) & (F.col("known") == F.col("n"))
    return met.select("graph_id", "block", "variable", F.when(one, "CONST").otherwise("BOTTOM").alias("state"), F.when(one, F.col("value")).alias("value"))


def copy_targets(instrs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(graph_id, variable, source): flow-insensitive copy propagation over copy_dst and copy_src; the last copy of a variable wins."""
    from arcstep.operators.traverse import follow

    pairs = instrs.where("copy_dst is not null").groupBy("graph_id", F.col("copy_dst").alias("node_id")).agg(F.max_by("copy_src", F.struct("block", "idx")).alias("next"))
    chain = follow(pairs, pairs.select("graph_id", "node_id"), max_hops)
    return chain.groupBy("graph_id", F.col("seed").alias("variable")).agg(F.max_by("node_id", "hop").alias("source"))
