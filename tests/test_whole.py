"""Graphs solved whole by tasks: as by rounds of joins, in chunks of any size, and without rounds."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from arcstep.operators import components, dataflow, dominance, frames, sccp, traverse, whole
from tests.test_graph import FIXED, build, random_graphs


@pytest.fixture(scope="module")
def many():
    rng = random.Random(3)
    larger = {f"z{i}": (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(int(1.4 * n))]) for i, n in enumerate((9, 14, 30))}
    return FIXED | random_graphs(12) | larger


@pytest.fixture(scope="module")
def g(spark, many):
    return build(spark, many)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture
def no_rounds(monkeypatch):
    """Fails where a loop of joins begins."""

    def begun(*_, **__):
        raise AssertionError("rounds of joins on small graphs")

    return lambda module, *names: [monkeypatch.setattr(module, name, begun) for name in names]


def as_by_rounds(monkeypatch, solve):
    """The rows of ``solve``, once from tasks alone, and equal to those with graphs of over six edges left to rounds."""
    alone = rows(solve())
    monkeypatch.setattr(whole, "MAX_EDGES", 6)
    assert rows(solve()) == alone
    return alone


def test_chunks_hold_whole_graphs(monkeypatch):
    names = ["a"] * 5 + ["b"] * 9 + ["c"] + ["d"] * 4
    table = pa.table({"graph_id": names, "at": pa.array([0] * 19, pa.int32()), "src": range(19), "dst": [k + 1 for k in range(19)]})
    for chunk in (1, 6, 100):
        monkeypatch.setattr(whole, "CHUNK", chunk)
        for size in (1, 2, 3, 19):
            parts = [t.column("graph_id").to_pylist() for t in whole._tables(iter(table.to_batches(max_chunksize=size)), ("graph_id",))]
            assert sum(parts, []) == names
            assert all(not set(p) & set(q) for k, p in enumerate(parts) for q in parts[k + 1 :])
            assert len(parts) == 1 or chunk < 100


def test_nodes_far_apart_keep_their_ids():
    far = [-(1 << 62), 5, (1 << 62) - 3]
    table = pa.table({"graph_id": ["a", "a", "b"], "at": pa.array([0, 0, 0], pa.int32()), "src": [far[0], far[1], far[2]], "dst": [far[1], far[2], far[0]]})
    w = whole.Whole(table, ("graph_id",))
    assert [(w.graph[k], w.ids[k]) for k in range(w.n)] == [(0, far[0]), (0, far[1]), (0, far[2]), (1, far[0]), (1, far[2])]
    assert [(w.ids[a], w.ids[b]) for a, b in zip(w.src, w.dst)] == [(far[0], far[1]), (far[1], far[2]), (far[2], far[0])]


def test_strong_components_without_rounds(g, no_rounds, monkeypatch):
    with monkeypatch.context() as m:
        as_by_rounds(m, lambda: components.strong_components(g))
    no_rounds(components, "closure", "relax", "pinned")
    assert components.strong_components(g).count() == g.nodes.count()


def test_searches_without_rounds(g, no_rounds, monkeypatch):
    seeds = g.roots.select("graph_id", F.col("root").alias("node_id"))
    two = g.nodes.groupBy("graph_id").agg(F.max("node_id").alias("b")).withColumn("a", F.lit(0).cast("long"))
    queries = [
        lambda: traverse.reachable(g, seeds, "backward"), lambda: traverse.distances(g, seeds), lambda: traverse.distances(g, seeds, max_depth=2, where="dst % 2 = 0"), lambda: traverse.breadth_first(g, seeds),
        lambda: traverse.shortest_path(g, two.withColumnsRenamed({"a": "start", "b": "goal"})), lambda: traverse.common_ancestors(g, two), lambda: traverse.nearest_common_ancestor(g, two),
    ]
    for solve in queries:
        with monkeypatch.context() as m:
            as_by_rounds(m, solve)
    no_rounds(traverse, "closure", "pinned")
    assert all(solve().count() for solve in queries)


def test_least_values_and_weak_components_without_rounds(spark, g, no_rounds, monkeypatch):
    own = g.nodes.where("node_id % 3 <> 1").select("graph_id", "node_id", F.when(F.col("node_id") % 5 != 2, 100 - F.col("node_id")).alias("value"))
    links = g.live().select("graph_id", F.col("src").alias("a"), F.when(F.col("edge_id") % 4 != 3, F.col("dst")).alias("b"))
    queries = [lambda: components.propagate_summaries(g, own), lambda: components.weak_components(links)]
    for solve in queries:
        with monkeypatch.context() as m:
            as_by_rounds(m, solve)
    no_rounds(components, "relax", "star_components")
    assert all(solve().count() for solve in queries)


def test_dominators_without_rounds(g, no_rounds, monkeypatch):
    queries = [lambda: dominance.dominators(g), lambda: dominance.immediate_dominators(g), lambda: dominance.post_dominators(g), lambda: dominance.post_dominator_tree(g)]
    for solve in queries:
        with monkeypatch.context() as m:
            as_by_rounds(m, solve)
    no_rounds(dominance.domtree, "parents_and_jumps", "immediate_dominators")
    assert all(solve().count() for solve in queries)


def test_least_labels_take_several_steps_a_round(spark, monkeypatch):
    written = []
    real = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: written.append(1) or real(df))
    # A chain of 18 nodes whose labels grow, and a detour that gives less to its second half.
    edges = spark.createDataFrame([(i, i + 1, 5) for i in range(17)] + [(0, 20, 1), (20, 21, 1), (21, 22, 1), (22, 9, 1), (17, 3, 0)], "src long, dst long, w long")
    step = lambda f: f.withColumnRenamed("node_id", "src").join(edges, "src").select(F.col("dst").alias("node_id"), (F.col("label") + F.col("w")).alias("label"))
    got = {r["node_id"]: r["label"] for r in frames.relax(spark.sql("select 0L as node_id, 0L as label"), step, ["node_id"], "label").collect()}
    want = {0: 0, 20: 1, 21: 2, 22: 3}
    want |= {i: 5 * i for i in range(9)} | {9 + i: 4 + 5 * i for i in range(9)}
    assert got == want
    assert len(written) <= 8


def test_conditional_constants_without_rounds(spark, g, monkeypatch):
    rng = random.Random(8)
    lines = [
        (r["graph_id"], r["node_id"], i, [rng.choice("abc")] if op != "load" else [], [rng.choice("abc")], op, rng.randrange(2))
        for r in sorted(g.nodes.collect()) for i, op in enumerate(rng.choices(["load", "add", "add", "call"], k=rng.randrange(4)))
    ]
    ins = spark.createDataFrame(lines, "graph_id string, block long, idx long, uses array<string>, defs array<string>, op string, value long")

    def fold(known):
        value = F.when(F.col("op") == "load", F.col("value")).when(F.col("op") == "add", known[F.get("uses", F.lit(0))] % 2 + F.col("value"))
        return F.when(value.isNotNull(), F.struct(F.col("defs")[0].alias("variable"), value.alias("value")))

    def fold_row(instr, known):
        read = 0 if instr["op"] == "load" else known.get(instr["uses"][0])
        return None if read is None or instr["op"] == "call" else (instr["defs"][0], read % 2 + instr["value"])

    dom = dominance.dominators(g)
    phis = frames.checkpoint(dataflow.place_phis(g, ins, dom))
    defs = frames.checkpoint(dataflow.ssa_definitions(ins, phis, dom))
    uses, operands = frames.checkpoint(dataflow.ssa_uses(ins, defs, dom)), frames.checkpoint(dataflow.phi_operands(g, phis, defs, dom))
    reached = dom.select("graph_id", F.col("node_id").alias("block")).distinct()
    solve = lambda **how: [rows(df) for df in sccp.sccp(g, ins, defs, uses, operands, fold, F.col("op") != "call", reached=reached, **how)]
    by_rounds = solve()
    assert {r[1] for r in by_rounds[0]} == {"BOTTOM", "CONST"}
    monkeypatch.setattr(sccp, "MAX_SITES", 14)
    assert solve(fold_row=fold_row) == by_rounds
    monkeypatch.setattr(sccp, "MAX_SITES", 1000)
    monkeypatch.setattr(sccp, "_settled", None)  # which all rounds need
    assert solve(fold_row=fold_row) == by_rounds
