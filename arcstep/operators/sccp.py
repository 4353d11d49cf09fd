"""Sparse conditional constant propagation over SSA values, with folding and branches given as columns.

Two tables grow together. A value is absent (not known yet), a constant, or
``bottom`` (varies); it only ever moves that way, at most twice. An edge is
executable once its source is and, if branches are given, once the value that the
branch tests lets it be taken. A round looks only at what the round before has
changed: instructions of blocks that are new, instructions and phis that read a
value that has moved, and phis of blocks that a new edge enters. A value read
before the first definition (version 0) varies.

Where the executable blocks are known and the folding is given as a Python function, too, graphs
of up to ``MAX_SITES`` instructions are solved whole by one task each, with a worklist of the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from arcstep.operators import whole
from arcstep.operators.frames import checkpoint, discard
from arcstep.operators.graph import Graph

BLOCK = ["graph_id", "block"]
SITE = ["graph_id", "block", "idx"]
VALUE = ["graph_id", "variable", "version"]
EDGE = ["graph_id", "edge_id"]

#: Instructions of a graph that one task takes; it holds about a kilobyte of each.
MAX_SITES = 1 << 17

#: Maps an instruction's columns and the constants that it reads to the variable it defines and its value, or to None.
RowFold = Callable[[dict, dict], "tuple[str, object] | None"]


def _settled(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(graph_id, variable, version, ...) rows with ``known`` (whether the value is not absent), ``bottom`` and ``value``."""
    held = values.select(*VALUE, F.lit(True).alias("held"), "bottom", "value")
    entry = F.col("version") == 0
    out = rows.join(held, VALUE, "left")
    return out.withColumn("known", entry | F.col("held").isNotNull()).withColumn("bottom", entry | F.coalesce("bottom", F.lit(False))).drop("held")


def sccp(
    graph: Graph,
    instrs: DataFrame,
    defs: DataFrame,
    uses: DataFrame,
    operands: DataFrame,
    fold: Callable[[Column], Column],
    foldable: Column | None = None,
    value_type: str = "bigint",
    reached: DataFrame | None = None,
    tests: DataFrame | None = None,
    takes: Column | None = None,
    fold_row: RowFold | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The values (graph_id, variable, version, state, value), state CONST or BOTTOM, of executable blocks, and the executable edges (graph_id, edge_id, src, dst).

    ``defs``, ``uses`` and ``operands`` come from ``ssa_definitions``, ``ssa_uses`` and
    ``phi_operands``. ``fold`` maps the constants that an instruction reads (a map from
    variable to value; the instruction's columns can be used, too) to a struct of
    the variable it defines and its value, or to null; everything else it defines varies.
    Instructions for which ``foldable`` is false are never folded and wait for nothing.

    Without ``tests`` all ways out of an executable block are executable; ``reached``
    (graph_id, block), such as the nodes of the dominator tree, then spares the rounds
    that find the blocks. ``tests`` (graph_id, block, variable, version) names the value that
    the end of a block tests, and ``takes``, over an edge's ``kind`` and that ``value``, the edges
    taken for a constant. ``fold_row`` is the same as ``fold``, which must be monotone, in Python;
    with it and ``reached`` graphs that fit a task take no rounds.
    """
    if fold_row is not None and tests is None and reached is not None:
        large = checkpoint(instrs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_SITES).select("graph_id"))
        parts = (instrs, defs, uses, operands, reached)
        if large.isEmpty():
            return _solved(graph, *parts, fold_row, foldable, value_type)
        of = lambda df, how: df.join(F.broadcast(large), "graph_id", how)
        part = lambda how: (Graph(of(graph.nodes, how), of(graph.edges, how)), *[of(df, how) for df in parts])
        g, ins, d, u, o, r = part("left_semi")
        by_rounds = sccp(Graph(g.nodes, g.edges, graph.roots), ins, d, u, o, fold, foldable, value_type, r)
        return tuple(a.unionByName(b) for a, b in zip(_solved(*part("left_anti"), fold_row, foldable, value_type), by_rounds, strict=True))
    live = checkpoint(graph.live().select("graph_id", "edge_id", F.col("src").alias("block"), "dst", "kind"))
    can = F.lit(True) if foldable is None else F.coalesce(foldable, F.lit(False))
    sites = checkpoint(instrs.withColumn("__can", can).join(defs.where("not is_phi").select(*SITE, "variable", "version"), SITE))
    reads = checkpoint(uses.select(*SITE, "variable", "version").distinct())
    inner = checkpoint(operands.select("graph_id", "block", "variable", "edge_id", "version"))
    phis = checkpoint(defs.where("is_phi").select("graph_id", "block", "variable", F.col("version").alias("result")))
    values = checkpoint(defs.select(*VALUE, F.lit(False).alias("bottom"), F.lit(None).cast(value_type).alias("value")).limit(0))
    moved = values
    if tests is None and reached is not None:
        blocks = checkpoint(reached.select(*BLOCK).distinct())
        new_edges = edges = checkpoint(live.join(blocks, BLOCK, "left_semi"))
    else:
        blocks = checkpoint(graph.roots.select("graph_id", F.col("root").alias("block")).distinct())
        new_edges = edges = checkpoint(live.limit(0))
    new_blocks = blocks
    while True:
        # What has to be looked at again.
        by_value = reads.join(moved.select(*VALUE), VALUE, "left_semi").join(blocks, BLOCK, "left_semi").select(*SITE)
        due = sites.join(new_blocks, BLOCK, "left_semi").select(*SITE).unionByName(by_value).distinct()
        entered = phis.join(new_edges.select("graph_id", F.col("dst").alias("block")), BLOCK, "left_semi").select("graph_id", "block", "variable")
        due_phis = entered.unionByName(inner.join(moved.select(*VALUE), VALUE, "left_semi").select("graph_id", "block", "variable")).distinct()

        # Instructions whose reads are all settled.
        own = _settled(due.join(reads, SITE), values).groupBy(*SITE).agg(
            F.min("known").alias("ready"),
            F.map_from_entries(F.collect_list(F.when(F.col("known") & ~F.col("bottom"), F.struct(F.col("variable").alias("k"), F.col("value").alias("v"))))).alias("__known"),
        )
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{value_type}>"))
        ready = sites.join(due, SITE, "left_semi").join(own, SITE, "left").where(~F.col("__can") | F.coalesce("ready", F.lit(True))).withColumn("__known", F.coalesce("__known", nothing))
        folded = ready.withColumn("__folded", F.when(F.col("__can"), fold(F.col("__known"))))
        result = F.when(F.col("__folded")["variable"] == F.col("variable"), F.col("__folded")["value"].cast(value_type))
        made = folded.select(*VALUE, result.isNull().alias("b"), result.alias("v"))

        # Phis over the edges that are executable; operands not known yet do not count.
        met = _settled(inner.join(due_phis, ["graph_id", "block", "variable"], "left_semi").join(edges.select(*EDGE), EDGE, "left_semi"), values).where("known")
        met = met.groupBy("graph_id", "block", "variable").agg(F.max("bottom").alias("any"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        varies = F.col("any") | (F.col("lo") != F.col("hi"))
        made = made.unionByName(met.join(phis, ["graph_id", "block", "variable"]).select("graph_id", "variable", F.col("result").alias("version"), varies.alias("b"), F.when(~varies, F.col("lo")).alias("v")))

        # Values only go down.
        joined = made.join(values.withColumn("old", F.lit(True)), VALUE, "left").where("old is null or (not bottom and (b or v <> value))")
        fallen = F.col("b") | F.col("old").isNotNull()
        moved = checkpoint(joined.select(*VALUE, fallen.alias("bottom"), F.when(~fallen, F.col("v")).alias("value")))
        if not moved.isEmpty():
            last, values = values, checkpoint(values.join(moved.select(*VALUE), VALUE, "left_anti").unionByName(moved))
            discard(last)

        if tests is None and reached is not None:
            new_blocks, new_edges = blocks.limit(0), edges.limit(0)
        else:
            new_edges = _taken(live, blocks, edges, values, tests, takes)
            if not new_edges.isEmpty():
                edges = checkpoint(edges.unionByName(new_edges))
            new_blocks = checkpoint(new_edges.select("graph_id", F.col("dst").alias("block")).distinct().join(blocks, BLOCK, "left_anti"))
            if not new_blocks.isEmpty():
                blocks = checkpoint(blocks.unionByName(new_blocks))
            if not new_edges.isEmpty():
                continue
        if moved.isEmpty():
            break
    state = F.when(F.col("bottom"), "BOTTOM").otherwise("CONST").alias("state")
    return values.select(*VALUE, state, "value"), edges.select("graph_id", "edge_id", F.col("block").alias("src"), "dst")


def _solved(
    graph: Graph, instrs: DataFrame, defs: DataFrame, uses: DataFrame, operands: DataFrame, reached: DataFrame, fold_row: RowFold, foldable: Column | None, value_type: str
) -> tuple[DataFrame, DataFrame]:
    """As ``sccp`` with all ways out executable, each graph by one task."""
    blocks = checkpoint(reached.select(*BLOCK).distinct())
    live = graph.live().select("graph_id", "edge_id", F.col("src").alias("block"), "dst")
    edges = checkpoint(live.join(blocks, BLOCK, "left_semi"))
    can = F.lit(True) if foldable is None else F.coalesce(foldable, F.lit(False))
    own = instrs.join(blocks, BLOCK, "left_semi").withColumn("can", can).withColumn("instr", F.struct(*instrs.columns))
    row = lambda df, kind: df.withColumn("kind", F.lit(kind))
    rows = row(own.select(*SITE, "can", "instr").join(defs.where("not is_phi").select(*SITE, "variable", "version"), SITE), 0)
    more = [
        row(uses.select(*SITE, "variable", "version").distinct(), 1),
        row(defs.where("is_phi").select(*BLOCK, "variable", "version"), 2),
        row(operands.join(edges.select(*EDGE), EDGE, "left_semi").select(*BLOCK, "variable", "version"), 3),
    ]
    for part in more:
        rows = rows.unionByName(part, allowMissingColumns=True)
    kernel = partial(_worklist, fold_row=fold_row, value_type=to_arrow_type(rows.sparkSession.createDataFrame([], f"v {value_type}").schema["v"].dataType))
    values = whole.solved(rows, kernel, f"variable string, version bigint, state string, value {value_type}", plain=True)
    return checkpoint(values), edges.select("graph_id", "edge_id", F.col("block").alias("src"), "dst")


def _worklist(table: pa.Table, fold_row: RowFold, value_type: pa.DataType) -> Iterator[dict]:
    new = whole.begins(table, ("graph_id",))
    names = table.column("graph_id").take(pa.array(np.flatnonzero(new)))
    get = lambda c: table.column(c).to_pylist()
    # [whether it folds, instruction, results, reads] of an instruction; [None, None, result, operands] of a phi.
    sites: dict[tuple, list] = {}
    phis: dict[tuple, list] = {}
    reads, operands = [], []
    for g, kind, block, idx, variable, version, can, instr in zip((np.cumsum(new) - 1).tolist(), *map(get, ("kind", "block", "idx", "variable", "version", "can", "instr")), strict=True):
        value = (g, variable, version)
        if kind == 0:
            sites.setdefault((g, block, idx), [can, instr, [], []])[2].append(value)
        elif kind == 1:
            reads.append(((g, block, idx), value))
        elif kind == 2:
            phis[g, block, variable] = [None, None, value, []]
        else:
            operands.append(((g, block, variable), value))
    readers: dict[tuple, list] = {}
    for places, pairs in ((sites, reads), (phis, operands)):
        for place, value in pairs:
            if (at := places.get(place)) is not None:
                at[3].append(value)
                readers.setdefault(value, []).append(at)
    bottom = object()
    held: dict[tuple, object] = {}
    look = lambda value: bottom if value[2] == 0 else held.get(value)
    due = [*sites.values(), *phis.values()]
    while due:
        can, instr, result, inputs = due.pop()
        known = [look(v) for v in inputs]
        if can is None:
            settled = [x for x in known if x is not None]
            if not settled:
                continue
            made = [(result, bottom if any(x is bottom or x != settled[0] for x in settled) else settled[0])]
        elif not can:
            made = [(v, bottom) for v in result]
        else:
            if any(x is None for x in known):
                continue
            folded = fold_row(instr, {v[1]: x for v, x in zip(inputs, known, strict=True) if x is not bottom})
            made = [(v, bottom if folded is None or folded[0] != v[1] or folded[1] is None else folded[1]) for v in result]
        for value, to in made:
            old = held.get(value)
            if old is bottom or (old is not None and to is not bottom and old == to):
                continue
            # Values only go down.
            held[value] = to if old is None else bottom
            due.extend(readers.get(value, ()))
    at = pa.array([v[0] for v in held], pa.int64())
    yield {
        "graph_id": names.take(at), "variable": pa.array([v[1] for v in held], pa.string()), "version": pa.array([v[2] for v in held], pa.int64()),
        "state": pa.array(["BOTTOM" if x is bottom else "CONST" for x in held.values()], pa.string()), "value": pa.array([None if x is bottom else x for x in held.values()], value_type),
    }


def _taken(live: DataFrame, blocks: DataFrame, edges: DataFrame, values: DataFrame, tests: DataFrame | None, takes: Column | None) -> DataFrame:
    """The edges that have become executable."""
    left = live.join(edges.select(*EDGE), EDGE, "left_anti").join(blocks, BLOCK, "left_semi")
    if tests is None or takes is None:
        return checkpoint(left)
    tested = _settled(tests.select("graph_id", "block", "variable", "version"), values).select(*BLOCK, F.lit(True).alias("tested"), "known", "bottom", "value")
    open_ = F.col("tested").isNull() | (F.col("known") & (F.col("bottom") | F.coalesce(takes, F.lit(False))))
    return checkpoint(left.join(tested, BLOCK, "left").where(open_).select(*live.columns))
