"""Call graphs, jumps by label, switch tables and exception regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import dense_ids
from arcstep.operators.graph import Graph, edges_of

BLOCK = ["graph_id", "block"]


def call_graph(functions: DataFrame, instrs: DataFrame) -> Graph:
    """One node for each key of (key, graph_id) rows, one edge for each call instruction whose callee is known.

    Several bodies of one key share its node; parallel calls stay; unresolved ones are dropped.
    """
    keys = functions.select("key").distinct()
    ids = dense_ids(keys, ["key"], "node_id").select("key", F.col("node_id").cast("long").alias("node_id"))
    nodes = ids.select(F.lit("calls").alias("graph_id"), "node_id", F.col("key").alias("payload"))
    caller = functions.join(ids, "key").select("graph_id", F.col("node_id").alias("src"))
    callee = ids.select(F.col("key").alias("callee"), F.col("node_id").alias("dst"))
    calls = instrs.where("callee is not null").join(caller, "graph_id").join(callee, "callee")
    numbered = dense_ids(calls.select("src", "dst", "graph_id", "block", "idx"), ["src", "graph_id", "block", "idx"], "edge_id")
    edges = numbered.select(F.lit("calls").alias("graph_id"), F.col("edge_id").cast("long").alias("edge_id"), "src", "dst", F.lit("Call").alias("kind"))
    return Graph(nodes, edges_of(edges))


def resolve_jumps(graph: Graph, instrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (graph_id, src, dst, kind) edges from jump_target to label tokens, and the unresolved (graph_id, block, jump_target).

    Of blocks with the same label the last wins; edges that exist are not added again.
    """
    labels = instrs.where("label is not null").groupBy("graph_id", F.col("label").alias("jump_target")).agg(F.max("block").alias("dst"))
    last = instrs.groupBy(*BLOCK).agg(F.max_by(F.struct("jump_target", "effect"), "idx").alias("l")).where("l.jump_target is not null")
    jumps = last.select("graph_id", "block", F.col("l.jump_target").alias("jump_target"), F.when(F.col("l.effect") == "ConditionalJump", "ConditionalTrue").otherwise("Jump").alias("kind"))
    found = jumps.join(labels, ["graph_id", "jump_target"]).select("graph_id", F.col("block").alias("src"), "dst", "kind")
    new = found.join(graph.live().select("graph_id", "src", "dst", "kind"), ["graph_id", "src", "dst", "kind"], "left_anti")
    return new, jumps.join(labels, ["graph_id", "jump_target"], "left_anti").select("graph_id", "block", "jump_target")


def switch_tables(instrs: DataFrame) -> DataFrame:
    """(graph_id, block, targets, default): the last instruction of a block that names switch targets."""
    last = instrs.where("switch_targets is not null").groupBy(*BLOCK).agg(F.max_by(F.struct("switch_targets", "switch_default"), "idx").alias("s"))
    return last.select("graph_id", "block", F.col("s.switch_targets").alias("targets"), F.col("s.switch_default").alias("default"))


def recover_switches(graph: Graph, tables: DataFrame, tokens: DataFrame) -> DataFrame:
    """The (graph_id, src, dst, kind) edges once switches are resolved by (graph_id, token, block) rows.

    Indirect jumps of resolved blocks go; each known target gets a SwitchCase edge in order, the default an Unconditional one.
    """
    at = tokens.select("graph_id", "token", F.col("block").alias("dst"))
    cases = tables.select("graph_id", F.col("block").alias("src"), F.posexplode("targets").alias("pos", "token")).join(at, ["graph_id", "token"])
    default = tables.where("default is not null").select("graph_id", F.col("block").alias("src"), F.col("default").alias("token")).join(at, ["graph_id", "token"])
    gone = tables.select("graph_id", F.col("block").alias("src"), F.lit("IndirectJump").alias("kind"))
    kept = graph.live().join(gone, ["graph_id", "src", "kind"], "left_anti").select("graph_id", "src", "dst", "kind")
    return (
        kept.unionByName(cases.select("graph_id", "src", "dst", F.lit("SwitchCase").alias("kind")))
        .unionByName(default.select("graph_id", "src", "dst", F.lit("Unconditional").alias("kind")))
    )


def protecting_region(regions: DataFrame) -> DataFrame:
    """(graph_id, block, region_id): the last added of (graph_id, region_id, protected) that protects a block."""
    return regions.select("graph_id", "region_id", F.explode("protected").alias("block")).groupBy(*BLOCK).agg(F.max("region_id").alias("region_id"))


_EXCEPTIONS = ("ExceptionHandler", "ExceptionUnwind")


def exception_edges(graph: Graph) -> DataFrame:
    """(graph_id, src, dst, unwind) of the edges to handlers."""
    edges = graph.live().where(F.col("kind").isin(*_EXCEPTIONS))
    return edges.select("graph_id", "src", "dst", (F.col("kind") == "ExceptionUnwind").alias("unwind"))


def protected_by(graph: Graph, regions: DataFrame, handlers: DataFrame) -> DataFrame:
    """(graph_id, node_id, block): the blocks whose exceptions come to a handler's entry, by edges and by regions."""
    by_edge = exception_edges(graph).select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("block"))
    blocks = regions.select("graph_id", "region_id", F.explode("protected").alias("block"))
    by_region = handlers.join(blocks, ["graph_id", "region_id"]).select("graph_id", F.col("entry").alias("node_id"), "block")
    return by_edge.unionByName(by_region).distinct()


def block_kinds(graph: Graph, handlers: DataFrame) -> DataFrame:
    """(graph_id, node_id, kind): landing pads by edges first, then the entries of handlers (graph_id, region_id, pos, entry, kind) by the handler's kind."""
    kind = F.when(F.col("kind").isin("Finally", "Fault"), "Cleanup").when(F.col("kind") == "Filter", "CatchSwitch").otherwise("LandingPad")
    by_edge = exception_edges(graph).select("graph_id", F.col("dst").alias("node_id"), F.struct(F.lit(-1).cast("long").alias("region_id"), F.lit(0).cast("long").alias("pos"), F.lit("LandingPad").alias("kind")).alias("k"))
    by_region = handlers.select("graph_id", F.col("entry").alias("node_id"), F.struct(F.col("region_id").cast("long").alias("region_id"), F.col("pos").cast("long").alias("pos"), kind.alias("kind")).alias("k"))
    best = by_edge.unionByName(by_region).groupBy("graph_id", "node_id").agg(F.min("k").alias("k"))
    return graph.nodes.select("graph_id", "node_id").join(best, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("k.kind", F.lit("Normal")).alias("kind"))


def landing_pads(kinds: DataFrame) -> DataFrame:
    return kinds.where("kind = 'LandingPad'").select("graph_id", "node_id")


def cleanup_blocks(kinds: DataFrame) -> DataFrame:
    return kinds.where("kind = 'Cleanup'").select("graph_id", "node_id")


def add_continuations(known: DataFrame, more: DataFrame) -> DataFrame:
    """(graph_id, region_id, pos, ord, reason, resume): distinct reasons and blocks of a handler, in first order."""
    both = known.withColumn("late", F.lit(0)).unionByName(more.withColumn("late", F.lit(1)))
    first = both.groupBy("graph_id", "region_id", "pos", "reason", "resume").agg(F.min(F.struct("late", "ord")).alias("at"))
    order = F.row_number().over(W.partitionBy("graph_id", "region_id", "pos").orderBy("at", "reason", "resume")) - 1
    return first.select("graph_id", "region_id", "pos", order.cast("long").alias("ord"), "reason", "resume")


def resumes_for(continuations: DataFrame, reason: str) -> DataFrame:
    """Where handlers resume for a completion reason, in order."""
    return continuations.where(F.col("reason") == reason).select("graph_id", "region_id", "pos", "ord", "resume")


# -- side tables of handlers, regions and blocks ---------------------------------------


def add_regions(known: DataFrame, more: DataFrame) -> DataFrame:
    """(graph_id, region_id, protected): new (graph_id, protected) regions behind the known ones, in the order of their blocks."""
    count = known.groupBy("graph_id").agg((F.max("region_id") + 1).alias("n"))
    numbered = dense_ids(more.select("graph_id", F.array_sort("protected").alias("protected")), ["protected"], "k", ["graph_id"]).join(count, "graph_id", "left")
    return known.unionByName(numbered.select("graph_id", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("long").alias("region_id"), "protected"))


def put(known: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with ``rows`` put in the place of those with the same keys: handler filters, cleanups' resume blocks, labels."""
    return known.join(rows, keys, "left_anti").unionByName(rows)


def remove(known: DataFrame, keys: DataFrame) -> DataFrame:
    """``known`` without the rows of the given keys."""
    return known.join(keys, keys.columns, "left_anti")


def explicit_tail_calls(instrs: DataFrame) -> DataFrame:
    """(graph_id, block, idx) of the instructions marked ``tail``."""
    return instrs.where("tail").select("graph_id", "block", "idx")


def push(instrs: DataFrame, rows: DataFrame) -> DataFrame:
    """``instrs`` with (graph_id, block, seq, ...) rows appended to their blocks, in the order of seq."""
    size = instrs.groupBy(*BLOCK).agg((F.max("idx") + 1).alias("n"))
    at = F.row_number().over(W.partitionBy(*BLOCK).orderBy("seq")) - 1
    new = rows.withColumn("k", at).join(size, BLOCK, "left").withColumn("idx", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("long"))
    return instrs.unionByName(new.drop("n", "k"), allowMissingColumns=True)
