"""Value numbering over instructions: equal expressions along dominator paths, and their removal.

Instructions are rows (graph_id, block, idx, uses, defs, op); a null op is an
instruction whose result nothing is known of. A value is named by the structure of
its expression down to such results and to variables that no definition reaches,
so all programs are numbered together, one round for each level of nesting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import checkpoint, discard

SITE = ["graph_id", "block", "idx"]


def operand_sources(instrs: DataFrame, dom: DataFrame | None = None) -> DataFrame:
    """(graph_id, block, idx, pos, variable, from_block, from_idx): the definition that each operand reads.

    That is the last one before it in its block, else, with ``dom``, the last one of
    the nearest dominator that has one; null where there is none.
    """
    reads = instrs.select(*SITE, F.posexplode("uses").alias("pos", "variable"))
    if dom is None:
        none = lambda kind: F.lit(None).cast(kind)
        defs = instrs.select(*SITE, none("int").alias("pos"), F.explode("defs").alias("variable"), F.col("idx").alias("made"))
        earlier = W.partitionBy("graph_id", "block", "variable").orderBy("idx").rangeBetween(W.unboundedPreceding, -1)
        marks = reads.withColumn("made", none("long")).unionByName(defs).withColumn("from_idx", F.max("made").over(earlier))
        return marks.where("pos is not null").select(*SITE, "pos", "variable", F.when(F.col("from_idx").isNotNull(), F.col("block")).alias("from_block"), "from_idx")
    defs = instrs.select("graph_id", F.col("block").alias("from_block"), F.col("idx").alias("from_idx"), F.explode("defs").alias("variable"))
    depth = dom.groupBy("graph_id", F.col("node_id").alias("from_block")).agg(F.count(F.lit(1)).alias("depth"))
    above = dom.select("graph_id", F.col("node_id").alias("block"), F.col("dom").alias("from_block")).join(depth, ["graph_id", "from_block"])
    last = defs.groupBy("graph_id", "from_block", "variable").agg(F.max("from_idx").alias("from_idx"))
    outer = reads.join(above.where("block <> from_block"), ["graph_id", "block"]).join(last, ["graph_id", "from_block", "variable"])
    own = reads.join(defs, ["graph_id", "variable"]).where("block = from_block").join(depth, ["graph_id", "from_block"])
    cols = [*SITE, "pos", "variable", "from_block", "from_idx", "depth"]
    near = outer.select(*cols).unionByName(own.select(*cols))
    rank = F.struct("depth", "from_idx", "from_block")
    before = near.where("block <> from_block or from_idx < idx")
    best = before.groupBy(*SITE, "pos").agg(F.max(rank).alias("m"))
    return reads.join(best, [*SITE, "pos"], "left").select(*SITE, "pos", "variable", F.col("m.from_block").alias("from_block"), F.col("m.from_idx").alias("from_idx"))


def value_names(instrs: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph_id, block, idx, value): equal values have equal names, within a graph."""
    known = checkpoint(instrs.where("op is null").select(*SITE, F.xxhash64(F.lit("site"), "block", "idx").alias("value")))
    left = checkpoint(instrs.where("op is not null").select(*SITE, "op"))
    operands = checkpoint(sources.join(left.select(*SITE), SITE, "left_semi"))
    while not left.isEmpty():
        result = known.select("graph_id", F.col("block").alias("from_block"), F.col("idx").alias("from_idx"), F.col("value").alias("operand"))
        met = operands.join(result, ["graph_id", "from_block", "from_idx"], "left").withColumn("operand", F.when(F.col("from_block").isNull(), F.xxhash64(F.lit("entry"), "variable")).otherwise(F.col("operand")))
        list_ = F.transform(F.array_sort(F.collect_list(F.struct("pos", "operand"))), lambda x: x["operand"])
        state = met.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"), F.count("operand").alias("k"), list_.alias("operands"))
        ready = left.join(state, SITE, "left").where("n is null or n = k").select(*SITE, F.xxhash64("op", F.coalesce("operands", F.array().cast("array<bigint>"))).alias("value"))
        new = checkpoint(ready)
        if new.isEmpty():
            raise ValueError("an operand's definition is no instruction of the same graph")
        known = known.unionByName(new)
        last, left = left, checkpoint(left.join(new, SITE, "left_anti"))
        discard(last)
    return checkpoint(known)


def redundant(instrs: DataFrame, names: DataFrame, dom: DataFrame | None = None) -> DataFrame:
    """(graph_id, block, idx) of expressions computed before: earlier in the block or, with ``dom``, in a dominator."""
    values = instrs.where("op is not null").select(*SITE).join(names, SITE)
    first = values.groupBy("graph_id", "block", "value").agg(F.min("idx").alias("first"))
    inside = values.join(first, ["graph_id", "block", "value"]).where("idx > first").select(*SITE)
    if dom is None:
        return inside
    above = dom.where("node_id <> dom").select("graph_id", F.col("node_id").alias("block"), F.col("dom").alias("at"))
    before = values.join(above, ["graph_id", "block"]).join(first.select("graph_id", F.col("block").alias("at"), "value"), ["graph_id", "at", "value"]).select(*SITE)
    return inside.union(before).distinct()


def count_redundant(found: DataFrame) -> DataFrame:
    """(graph_id, redundant)."""
    return found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("redundant"))


def eliminate(instrs: DataFrame, found: DataFrame) -> DataFrame:
    """Instructions without the redundant ones, their places closed up."""
    kept = instrs.join(found, SITE, "left_anti")
    return kept.withColumn("idx", (F.row_number().over(W.partitionBy("graph_id", "block").orderBy("idx")) - 1).cast("long"))
