"""Control-flow graphs from flat streams of structured instructions.

A stream has rows (graph_id, seq, effect, ...), seq giving the order. Scopes are
matched by depth: the scope around an instruction is the last one opened at the
depth it stands at, which a window over (graph, depth) finds without a stack.
Block ids follow from running sums of the blocks that each effect starts, so all
streams are built at once by windows and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import checkpoint, dense_ids
from arcstep.operators.graph import Graph, edges_of
from arcstep.operators.traverse import chase

#: Kinds of scopes by the effects that open, continue and close them.
OPENS = {"ConditionalOpen": "If", "SwitchOpen": "Switch", "LoopOpen": "Loop"}
INNER = {"ConditionalAlternate": "If", "SwitchCase": "Switch"}
CLOSES = {"ConditionalClose": "If", "SwitchClose": "Switch", "LoopClose": "Loop"}
#: Blocks that an effect starts; those not named start none.
NEW_BLOCKS = {
    **dict.fromkeys((*OPENS, *INNER, *CLOSES), 1), "Break": 1, "ConditionalBreak": 2, "Continue": 1, "ConditionalContinue": 1, "Return": 1, "Terminate": 1,
    "Jump": 1, "IndirectJump": 1, "ConditionalReturn": 2, "Label": 1, "ConditionalJump": 1,
}
#: Effects whose instruction begins the new block, and those whose instruction is not kept.
BEGINS = (*INNER, "Label")
#: What goes wrong where a scope is missing or of another kind.
ERRORS = {
    "ConditionalAlternate": "UnmatchedElse", "ConditionalClose": "UnmatchedEndIf", "SwitchCase": "UnmatchedSwitchCase", "SwitchClose": "UnmatchedEndSwitch",
    "LoopClose": "UnmatchedEndLoop", "Break": "BreakOutsideScope", "ConditionalBreak": "BreakOutsideScope", "Continue": "ContinueOutsideLoop", "ConditionalContinue": "ContinueOutsideLoop",
}


def _by(effects: dict, otherwise: Column) -> Column:
    out = F
    for effect, value in effects.items():
        out = out.when(F.col("effect") == effect, F.lit(value))
    return out.otherwise(otherwise)


def step_of() -> Column:
    """1 for effects that open a scope, -1 for those that close one."""
    return F.when(F.col("effect").isin(*OPENS), 1).when(F.col("effect").isin(*CLOSES), -1).otherwise(0)


def enclosing(stream: DataFrame, step: Column) -> DataFrame:
    """Adds ``depth`` before each row of (graph_id, seq) and ``scope``, the seq that opened the innermost scope around it.

    ``step`` is 1 where a scope opens and -1 where one closes; a closing row is inside the scope that it closes.
    """
    names = [F.col(f"`{x}`") for x in stream.columns]
    row = F.struct(*names).alias("row")
    w = W.partitionBy("graph_id").orderBy("seq")
    rows = stream.select("graph_id", "seq", row, step.alias("step"), (F.sum(step).over(w) - step).cast("long").alias("depth"))
    # Every row asks at its depth; rows that open a scope also answer one deeper.
    levels = F.when(F.col("step") == 1, F.array(F.col("depth"), F.col("depth") + 1)).otherwise(F.array("depth"))
    placed = rows.withColumn("level", F.explode(levels))
    answer = F.when(F.col("level") > F.col("depth"), F.col("seq"))
    at = W.partitionBy("graph_id", "level").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    asked = placed.withColumn("scope", F.last(answer, ignorenulls=True).over(at)).where("level = depth")
    return asked.select("row.*", "depth", F.when(F.col("depth") > 0, F.col("scope")).alias("scope"))


@dataclass(frozen=True)
class Built:
    """The graph, the instructions (with block and idx), and (graph_id, seq, error, remaining) of the streams that have no graph."""

    graph: Graph
    instructions: DataFrame
    errors: DataFrame


def build(stream: DataFrame) -> Built:
    """Graphs of all well-formed streams; for the others their first error.

    ``stream`` has graph_id, seq (unique in it) and effect; other columns stay with
    the instructions. Blocks that end a stream empty and without a predecessor are
    trimmed, together with the edges that leave them.
    """
    key = ["graph_id", "scope"]
    new = _by(NEW_BLOCKS, F.lit(0)).cast("long")
    w = W.partitionBy("graph_id").orderBy("seq")
    rows = enclosing(stream, step_of()).withColumn("after", F.sum(new).over(w)).withColumn("before", F.col("after") - new)
    rows = checkpoint(rows)
    opened = rows.where(F.col("effect").isin(*OPENS)).select("graph_id", F.col("seq").alias("scope"), _by(OPENS, F.lit(None)).alias("kind"), F.col("scope").alias("parent"), F.col("before").alias("pre"), F.col("after").alias("header"))
    closing = rows.where(F.col("effect").isin(*CLOSES)).select("graph_id", "scope", F.col("after").alias("merge"), F.col("before").alias("last"), F.col("seq").alias("closed"), _by(CLOSES, F.lit(None)).alias("closes"))
    scopes = checkpoint(opened.join(closing, key, "left"))

    def nearest(kinds: list[str], name: str) -> DataFrame:
        """The innermost scope of the kinds around or at each scope."""
        links = scopes.where(~F.col("kind").isin(*kinds) & F.col("parent").isNotNull()).select("graph_id", F.col("scope").alias("node_id"), F.col("parent").alias("next"))
        own = scopes.where(F.col("kind").isin(*kinds)).select(*key)
        far = chase(links).select("graph_id", F.col("node_id").alias("scope"), F.col("end").alias(name)).join(own.withColumnRenamed("scope", name), ["graph_id", name], "left_semi")
        return own.select(*key, F.col("scope").alias(name)).unionByName(far.select(*key, name))

    full = rows.join(scopes.select(*key, "kind", "pre", "header"), key, "left").join(nearest(["Loop", "Switch"], "broken"), key, "left").join(nearest(["Loop"], "loop"), key, "left")
    full = checkpoint(full)

    # -- errors: the first in the stream, else scopes left open at its end
    wanted = _by({**INNER, **CLOSES}, F.lit(None))
    bad = (
        F.when(wanted.isNotNull() & ~wanted.eqNullSafe(F.col("kind")), True)
        .when(F.col("effect").isin("Break", "ConditionalBreak") & F.col("broken").isNull(), True)
        .when(F.col("effect").isin("Continue", "ConditionalContinue") & F.col("loop").isNull(), True)
        .otherwise(False)
    )
    first = full.where(bad).groupBy("graph_id").agg(F.min(F.struct("seq", _by(ERRORS, F.lit(None)).alias("error"))).alias("e")).select("graph_id", "e.seq", "e.error", F.lit(0).cast("long").alias("remaining"))
    open_ = rows.groupBy("graph_id").agg(F.sum(step_of()).cast("long").alias("remaining")).where("remaining > 0").join(first, "graph_id", "left_anti")
    errors = checkpoint(first.unionByName(open_.select("graph_id", F.lit(None).cast(first.schema["seq"].dataType).alias("seq"), F.lit("UnclosedScopes").alias("error"), "remaining")))
    fine = full.join(errors, "graph_id", "left_anti")
    good = checkpoint(scopes.join(errors, "graph_id", "left_anti"))

    # -- edges: (seq and place of the edge's making, src, dst, kind)
    is_ = lambda *effects: fine.where(F.col("effect").isin(*effects))
    edge = lambda df, src, dst, kind, pos=0, at="seq": df.select("graph_id", F.col(at).alias("made"), F.lit(pos).cast("long").alias("pos"), F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(kind).alias("kind"))
    arms = is_(*INNER).select(*key, F.col("before").alias("arm"), "seq").join(good, key)
    last = good.where("kind <> 'Loop'")
    breaks = is_("Break", "ConditionalBreak").select("graph_id", F.col("broken").alias("scope"), F.when(F.col("effect") == "Break", F.col("before")).otherwise(F.col("before") + 1).alias("exit"), "seq").join(good, key)
    parts = [
        edge(is_("ConditionalOpen"), "before", "after", "ConditionalTrue"),
        edge(is_("ConditionalAlternate"), "pre", "after", "ConditionalFalse"),
        edge(is_("SwitchOpen"), "before", "after", "SwitchCase"),
        edge(is_("SwitchCase"), "pre", "after", "SwitchCase"),
        edge(is_("LoopOpen", "Label"), "before", "after", "Fallthrough"),
        edge(is_("LoopClose"), "before", "header", "Back", -2),
        edge(is_("Continue"), "before", "header", "Back"),
        edge(is_("ConditionalContinue"), "before", "header", "ConditionalTrue"),
        edge(is_("ConditionalBreak", "ConditionalReturn"), "before", "before + 1", "ConditionalTrue"),
        edge(is_("ConditionalBreak", "ConditionalReturn", "ConditionalContinue", "ConditionalJump"), "before", "after", "ConditionalFalse", 1),
        # Arms meet in the order of their ends, the last one after them, then what no alternate takes, then the breaks.
        arms.select("graph_id", F.col("closed").alias("made"), (F.col("seq") - F.col("closed") - 3).cast("long").alias("pos"), F.col("arm").alias("src"), F.col("merge").alias("dst"), F.lit("Fallthrough").alias("kind")),
        edge(last, "last", "merge", "Fallthrough", -1, "closed"),
        edge(good.where("kind = 'If'").join(is_("ConditionalAlternate").select(*key), key, "left_anti"), "pre", "merge", "ConditionalFalse", 0, "closed"),
        breaks.select("graph_id", F.col("closed").alias("made"), (F.col("seq") + 1).cast("long").alias("pos"), F.col("exit").alias("src"), F.col("merge").alias("dst"), F.lit("Unconditional").alias("kind")),
    ]
    # The innermost scope's header is not the loop's where other scopes are between.
    headers = good.where("kind = 'Loop'").select("graph_id", F.col("scope").alias("loop"), F.col("header").alias("to"))
    to_header = is_("Continue", "ConditionalContinue").join(headers, ["graph_id", "loop"])
    parts[6] = edge(to_header.where("effect = 'Continue'"), "before", "to", "Back")
    parts[7] = edge(to_header.where("effect = 'ConditionalContinue'"), "before", "to", "ConditionalTrue")
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    edges = checkpoint(edges)

    # -- blocks, without the empty ones at the end that nothing leads to
    stored = fine.where(~F.col("effect").isin(*CLOSES)).withColumn("block", F.when(F.col("effect").isin(*BEGINS), F.col("after")).otherwise(F.col("before")))
    count = fine.groupBy("graph_id").agg((F.max("after")).alias("top"))
    used = stored.select("graph_id", "block").unionByName(edges.select("graph_id", F.col("dst").alias("block"))).groupBy("graph_id").agg(F.max("block").alias("used"))
    kept = count.join(used, "graph_id", "left").select("graph_id", F.greatest(F.coalesce("used", F.lit(0)), F.lit(0)).alias("top"))
    nodes = checkpoint(kept.select("graph_id", F.explode(F.expr("sequence(0L, top)")).alias("node_id")).withColumn("payload", F.lit(None).cast("string")))
    edges = edges.join(kept, "graph_id").where("src <= top").drop("top")
    numbered = dense_ids(edges, ["made", "pos"], "edge_id", ["graph_id"]).select("graph_id", "edge_id", "src", "dst", "kind")
    idx = (F.row_number().over(W.partitionBy("graph_id", "block").orderBy("seq")) - 1).cast("long")
    instructions = stored.withColumn("idx", idx).select(*[F.col(f"`{x}`") for x in stream.columns], "block", "idx")
    roots = nodes.where("node_id = 0").select("graph_id", F.col("node_id").alias("root"))
    return Built(Graph(nodes, checkpoint(edges_of(numbered)), roots), checkpoint(instructions), errors)
