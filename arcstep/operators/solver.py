"""Fixpoints of keyed facts over many graphs: one worklist for all of them, kept as tables.

A fact is a row (graph_id, node_id, key, fact): a set is one row a member, a map one
row an entry, a scalar one row. Rows that are absent are bottom. Every round visits the
nodes whose inputs have changed, and only these: their facts are met over the edges
that enter them, transferred, and compared with what left them before; where that differs,
the nodes behind are visited next. What is known is kept in parts, one a round, in
which the last one that visited a node holds; the parts are joined now and then. A round
looks up only the nodes that it visits and those before them, so that it moves no more than these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import COMPACT, LARGE, MAX_ROUNDS, checkpoint, dealt, discard
from arcstep.operators.graph import Graph

NODE = ["graph_id", "node_id"]
FACT = [*NODE, "key"]

#: Maps the visited nodes (graph_id, node_id) and the facts met there to the facts that leave them.
Transfer = Callable[[DataFrame, DataFrame], DataFrame]


def gen_kill(gen: DataFrame, kill: DataFrame) -> Transfer:
    """The transfer that takes (graph_id, node_id, key) rows of ``kill`` away and then adds (graph_id, node_id, key, fact) rows of ``gen``."""
    gen, kill = dealt(gen.select(*FACT, "fact"), NODE), dealt(kill.select(*FACT).distinct(), FACT)

    def transfer(nodes: DataFrame, facts: DataFrame) -> DataFrame:
        added = gen.join(nodes, NODE, "left_semi")
        return facts.join(kill, FACT, "left_anti").join(added.select(*FACT), FACT, "left_anti").unionByName(added)

    return transfer


class _Parts:
    """Facts in parts of (graph_id, node_id, key, fact, side, visit) rows, one row with a null key for every visited node.

    Large parts lie in buckets of the nodes, so that what is asked for comes to them and they do not move.
    """

    def __init__(self) -> None:
        self.placed: list[DataFrame] = []
        self.recent: list[DataFrame] = []

    def add(self, part: DataFrame, rows: int) -> DataFrame:
        part = dealt(part, NODE, rows)
        parts = self.placed if rows > LARGE else self.recent
        parts.append(part)
        if len(parts) > COMPACT:
            old = parts[:-1]  # the last part is still read
            whole = checkpoint(_last_visits(old))
            size = whole.count()
            discard(*old)
            del parts[:-1]
            if size > LARGE:
                self.placed.insert(0, dealt(whole, NODE, size))
            else:
                self.recent.insert(0, whole)
        return part

    def rows(self, nodes: DataFrame | None = None) -> DataFrame:
        """The rows of the last visit of every node, or of those of ``nodes`` only."""
        parts = self.placed + self.recent
        return _last_visits(parts if nodes is None else [p.join(nodes, NODE, "left_semi") for p in parts])


def _last_visits(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("__last", F.max("visit").over(W.partitionBy(*NODE))).where("visit = __last").drop("__last")


def solve_keyed(
    graph: Graph,
    transfer: Transfer,
    meet: Callable[[str], Column],
    direction: str = "forward",
    boundary: DataFrame | None = None,
    seeds: DataFrame | None = None,
    bottom: DataFrame | None = None,
    widen: Callable[[Column, Column], Column] | None = None,
    widen_after: int = 8,
    types: tuple[str, str] = ("string", "boolean"),
) -> tuple[DataFrame, DataFrame]:
    """The facts (graph_id, node_id, key, fact) that enter and that leave every visited node.

    ``meet`` names an aggregate over the facts of one key. ``boundary`` rows enter their
    nodes beside what comes over edges. ``seeds`` (graph_id, node_id) are the nodes visited
    first, by default all; nodes that no change reaches stay at ``bottom`` (rows that
    leave nodes from the beginning, by default none) and have no result. ``widen`` maps the fact
    that left a node before and the new one to the one kept, from round
    ``widen_after`` on, so that chains without end are cut off. ``types`` are those of key and
    fact. Meet and transfer must be monotone.
    """
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    pairs = checkpoint(graph.live().select("graph_id", F.col(a).alias("before"), F.col(b).alias("node_id")).distinct())
    size = pairs.count()
    into, onward = dealt(pairs, NODE, size, keep=True), dealt(pairs, ["graph_id", "before"], size)
    nothing = [F.lit(None).cast(t).alias(n) for t, n in zip(types, ("key", "fact"), strict=True)]
    due = checkpoint((graph.nodes if seeds is None else seeds).select(*NODE).distinct())
    known = _Parts()
    for rounds in range(MAX_ROUNDS):
        # Only the nodes before the visited ones and these themselves are looked up in what is known.
        over = into.join(due, NODE, "left_semi")
        asked = over.select("graph_id", F.col("before").alias("node_id")).unionByName(due).distinct()
        found = left = None
        if rounds:
            found = checkpoint(known.rows(asked).where("key is null or side = 'out'"))
            left = found.where("key is not null").select(*FACT, "fact")
        if bottom is not None:
            rest = bottom.select(*FACT, "fact").join(asked, NODE, "left_semi")
            left = rest if left is None else left.unionByName(rest.join(found.where("key is null").select(*NODE), NODE, "left_anti"))
        given = None if boundary is None else boundary.select(*FACT, "fact").join(due, NODE, "left_semi")
        if left is not None:
            met_over = over.join(left.withColumnRenamed("node_id", "before"), ["graph_id", "before"]).select(*FACT, "fact")
            given = met_over if given is None else given.unionByName(met_over)
        if given is None:
            given = due.select(*NODE, *nothing).limit(0)
        met = given.groupBy(*FACT).agg(meet("fact").alias("fact"))
        new = transfer(due, met).select(*FACT, "fact")
        old = None if left is None else left.join(due, NODE, "left_semi")
        if widen is not None and old is not None and rounds >= widen_after:
            new = new.join(old.withColumnRenamed("fact", "__old"), FACT, "left").withColumn("fact", F.when(F.col("__old").isNull(), F.col("fact")).otherwise(widen(F.col("__old"), F.col("fact")))).select(*FACT, "fact")
        mark = due.select(*NODE, *nothing, F.lit("node").alias("side"))
        rows = mark.unionByName(met.withColumn("side", F.lit("in"))).unionByName(new.withColumn("side", F.lit("out")))
        part = checkpoint(rows.withColumn("visit", F.lit(rounds)))
        part = known.add(part, part.count())
        now = part.where("side = 'out'").select(*FACT, "fact")
        if old is None:
            changed = now.select(*NODE).distinct()
        else:
            both = now.withColumn("__new", F.lit(True)).join(old.select(*FACT, F.col("fact").alias("__old"), F.lit(True).alias("__was")), FACT, "full")
            changed = both.where("__new is null or __was is null or not (fact <=> __old)").select(*NODE).distinct()
        last, due = due, checkpoint(changed.withColumnRenamed("node_id", "before").join(onward, ["graph_id", "before"]).select(*NODE).distinct())
        discard(last)
        if found is not None:
            discard(found)
        if due.isEmpty():
            rows = checkpoint(known.rows())
            return tuple(rows.where(F.col("side") == side).select(*FACT, "fact") for side in ("in", "out"))
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
