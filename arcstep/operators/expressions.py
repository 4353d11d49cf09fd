"""Expression trees of blocks: operations with the single-use values they read put into them.

A value that its block reads once is put into the operation that reads it, if the
block defines it before. Every value so has at most one place, and trees are chains of
parents: paths from the roots come from pointer doubling, and sizes, depths and texts
are aggregates over (tree, path) rows. Which values live beyond the block does not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import MAX_ROUNDS, checkpoint, discard

SITE = ["graph_id", "block", "idx"]
NODE = [*SITE, "variable"]


def expression_nodes(instrs: DataFrame) -> DataFrame:
    """(graph_id, block, idx, variable, kind, label, uses, parent, pos) of the values that instructions define.

    ``instrs`` has (graph_id, block, idx, uses, defs, constant, operator): a constant makes a
    CONST, an operator an OP of the uses, both for the first variable defined; anything
    else is OPAQUE for each. ``parent`` is the idx of the operation that a value is put into, at
    operand ``pos``; values that are overwritten before the block ends, without being put anywhere, have ``lost`` set.
    """
    kind = F.when(F.col("constant").isNotNull(), "CONST").when(F.col("operator").isNotNull(), "OP").otherwise("OPAQUE")
    made = instrs.withColumn("kind", kind).withColumn("made", F.when(F.col("kind") == "OPAQUE", F.col("defs")).otherwise(F.slice("defs", 1, 1)))
    label = F.when(F.col("kind") == "CONST", F.col("constant").cast("string")).when(F.col("kind") == "OP", F.col("operator")).otherwise(F.concat(F.lit("?"), F.col("idx").cast("string")))
    nodes = made.select(*SITE, F.explode("made").alias("variable"), "kind", label.alias("label"), "uses")
    nodes = checkpoint(nodes.withColumn("uses", F.when(F.col("kind") == "OP", F.col("uses")).otherwise(F.array().cast("array<string>"))))
    reads = instrs.select(*SITE, "operator", "constant", F.posexplode("uses").alias("pos", "variable"))
    once = reads.groupBy("graph_id", "block", "variable").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("reader"), F.max("pos").alias("pos"), F.max(F.col("operator").isNotNull() & F.col("constant").isNull()).alias("by_op"))
    once = once.where("n = 1 and by_op").drop("n", "by_op")
    # The last definition before the one read is put there.
    key = ["graph_id", "block", "variable"]
    put = nodes.join(once, key).where("idx < reader").groupBy(*key).agg(F.max("idx").alias("idx"), F.max("reader").alias("parent"), F.max("pos").cast("long").alias("pos"))
    later = F.lead("idx").over(W.partitionBy(*key).orderBy("idx"))
    return nodes.withColumn("next", later).join(put, NODE, "left").select(
        *NODE, "kind", "label", "uses", "parent", "pos", (F.col("parent").isNull() & F.col("next").isNotNull()).alias("lost")
    )


def tree_paths(nodes: DataFrame) -> DataFrame:
    """The nodes with ``root_idx``, ``root`` (the root's variable) and ``path``, the operands that lead from it; values that are lost or below one are left out."""
    # An operation defines one variable, so its place names it.
    owner = nodes.where("kind = 'OP'").select("graph_id", "block", F.col("idx").alias("at"), F.col("variable").alias("at_variable"))
    state = checkpoint(
        nodes.select(*NODE, "lost", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("pos")).alias("path"), F.col("parent").isNull().alias("done"))
        .join(owner, ["graph_id", "block", "at"], "left")
        .select(*NODE, F.coalesce("at", "idx").alias("at"), F.coalesce("at_variable", "variable").alias("at_variable"), "path", "done", "lost")
    )
    for _ in range(MAX_ROUNDS):
        if state.where("not done").isEmpty():
            break
        up = state.select("graph_id", "block", F.col("idx").alias("at"), F.col("variable").alias("at_variable"), F.col("at").alias("to"), F.col("at_variable").alias("to_variable"), F.col("path").alias("above"), F.col("done").alias("ended"), F.col("lost").alias("gone"))
        moved = state.where("not done").join(up, ["graph_id", "block", "at", "at_variable"]).select(
            *NODE, F.col("to").alias("at"), F.col("to_variable").alias("at_variable"), F.concat("above", "path").alias("path"), F.col("ended").alias("done"), F.col("gone").alias("lost")
        )
        last, state = state, checkpoint(state.where("done").unionByName(moved))
        discard(last)
    placed = state.where("not lost").select(*NODE, F.col("at").alias("root_idx"), F.col("at_variable").alias("root"), "path")
    return nodes.drop("lost").join(placed, NODE)


def expression_trees(instrs: DataFrame) -> DataFrame:
    """(graph_id, block, idx, variable, depth, nodes, text) of every root: what no later operation of its block has taken in."""
    nodes = checkpoint(expression_nodes(instrs))
    placed = checkpoint(tree_paths(nodes))
    inner = nodes.where("parent is not null").select("graph_id", "block", F.col("parent").alias("idx"), "pos", F.lit(True).alias("inner"))
    operands = placed.where("kind = 'OP'").select(*SITE, "root_idx", "root", "path", F.posexplode("uses").alias("pos", "leaf")).withColumn("pos", F.col("pos").cast("long"))
    leaves = operands.join(inner, [*SITE, "pos"], "left").where("inner is null").select("graph_id", "block", "root_idx", "root", F.concat("path", F.array("pos")).alias("path"), F.col("leaf").alias("text"), F.lit(True).alias("node"))
    # An operation opens at its path, and closes behind all that is below it.
    is_op = F.col("kind") == "OP"
    opens = placed.select("graph_id", "block", "root_idx", "root", "path", F.when(is_op, F.concat("label", F.lit("("))).otherwise(F.col("label")).alias("text"), F.lit(True).alias("node"))
    closes = placed.where(is_op).select("graph_id", "block", "root_idx", "root", F.concat("path", F.array(F.lit(1 << 40))).alias("path"), F.lit(")").alias("text"), F.lit(False).alias("node"))
    comma = F.when(F.col("node") & (F.size("path") > 0) & (F.element_at("path", -1) > 0), F.lit(",")).otherwise(F.lit(""))
    tokens = leaves.unionByName(opens).unionByName(closes).withColumn("text", F.concat(F.when(F.size("path") > 0, comma).otherwise(F.lit("")), "text"))
    trees = tokens.groupBy("graph_id", "block", F.col("root_idx").alias("idx"), F.col("root").alias("variable")).agg(
        (F.max(F.when(F.col("node"), F.size("path"))) + 1).cast("long").alias("depth"), F.count(F.when(F.col("node"), 1)).alias("nodes"), F.array_sort(F.collect_list(F.struct("path", "text"))).alias("tokens")
    )
    return trees.select("graph_id", "block", "idx", "variable", "depth", "nodes", F.array_join(F.col("tokens.text"), "").alias("text"))
