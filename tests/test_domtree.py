"""Dominator trees without dominator sets: random graphs, long chains, changed graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arcstep.operators import dominance, domtree, graph
from tests.test_graph import FIXED, build, random_graphs, reach


def brute_tree(edges, roots=(0,)):
    """node -> (idom, depth) under a root above all roots."""
    es = [("above", r) for r in roots] + list(edges)
    live = reach(es, "above") - {"above"}
    dom = {x: {d for d in live if x == d or x not in reach(es, "above", without=d)} for x in live}
    return {x: (max(dom[x] - {x}, key=lambda d: len(dom[d]), default=None), len(dom[x]) - 1) for x in live}


def got_trees(df):
    out: dict = {}
    for r in df.collect():
        assert r["node_id"] not in out.setdefault(r["graph_id"], {})
        out[r["graph_id"]][r["node_id"]] = (r["idom"], r["depth"])
    return out


def larger_graphs(k, seed=9):
    rng = random.Random(seed)
    out = {}
    for i in range(k):
        n = rng.randint(10, 25)
        # Mostly forward, some back and across: nested and irreducible parts, unreachable ones, too.
        out[f"l{i}"] = n, [(a, min(n - 1, max(0, a + rng.choice([1, 1, 1, 2, 3, 7, -2, -5])))) for a in (rng.randrange(n) for _ in range(int(1.6 * n)))]
    return out


@pytest.fixture(scope="module")
def many():
    ladder = [(3 * i + a, 3 * i + b) for i in range(20) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    crossed = [(2 * i + a, 2 * i + b) for i in range(3) for a, b in ((1, 3), (1, 4), (2, 3), (2, 4))] + [(0, 1), (0, 2)]
    ring = [(0, 1), (2, 3), (3, 4), (4, 2), (4, 1), (5, 2), (1, 6)]
    return FIXED | random_graphs(15) | larger_graphs(8) | {"ladder": (61, ladder), "crossed": (9, crossed), "ring": (7, ring)}


def test_trees_equal_brute_force(spark, many):
    assert got_trees(domtree.immediate_dominators(build(spark, many))) == {k: brute_tree(es) for k, (_, es) in many.items()}


def test_several_roots_and_post_dominators(spark, many):
    some = {k: v for k, v in many.items() if k in ("metrics", "ladder", "crossed", "l1", "l2", "two_cycles")}
    g = build(spark, some)
    roots = g.nodes.where("node_id in (0, 2)").select("graph_id", F.col("node_id").alias("root"))
    assert got_trees(domtree.immediate_dominators(g, roots)) == {k: brute_tree(es, (0, 2)) for k, (_, es) in some.items()}
    back = {k: ([(b, a) for a, b in es], [x for x in range(n) if all(a != x for a, _ in es)] or [n - 1]) for k, (n, es) in some.items()}
    assert got_trees(dominance.post_dominator_tree(g)) == {k: brute_tree(es, ends) for k, (es, ends) in back.items()}


def test_chain_of_100000_nodes(spark):
    n = 100_000
    ids = spark.range(n).select(F.lit("c").alias("graph_id"), F.col("id").alias("node_id"), F.lit(None).cast("string").alias("payload"))
    # The chain, a loop round all of it, and a bridge from its first half to its end.
    edges = spark.range(n - 1).selectExpr("'c' as graph_id", "id as edge_id", "id as src", "id + 1 as dst").union(spark.sql(f"select 'c', {n}L, {n - 1}L, 0L union all select 'c', {n + 1}L, 1000L, {n - 1}L"))
    g = graph.Graph(ids, graph.edges_of(edges), spark.sql("select 'c' as graph_id, 0L as root"))
    tree = domtree.immediate_dominators(g)
    assert tree.count() == n
    assert tree.where(f"node_id < {n - 1} and not (depth = node_id and idom <=> if(node_id = 0, null, node_id - 1))").count() == 0
    assert [tuple(r) for r in tree.where(f"node_id = {n - 1}").select("idom", "depth").collect()] == [(1000, 1001)]


def test_rounds_leave_out_settled_graphs_and_plans_stay_short(spark, monkeypatch):
    trees, joins = [], []

    class Counted(domtree.Jumps):
        def __init__(self, parents):
            trees.append(parents.count())
            super().__init__(parents)

    real = domtree.checkpoint
    monkeypatch.setattr(domtree, "Jumps", Counted)
    monkeypatch.setattr(domtree, "checkpoint", lambda df: joins.append(df._jdf.queryExecution().analyzed().toString().count("Join ")) or real(df))
    chains = {f"c{i}": (5, [(k, k + 1) for k in range(4)]) for i in range(12)}
    # Two ways of 40 nodes each that meet again, and a diamond behind them.
    ways = [(0, 1), (0, 41), (40, 81), (80, 81), (81, 82), (81, 83), (82, 84), (83, 84)] + [(k, k + 1) for s in (1, 41) for k in range(s, s + 39)]
    some = chains | {"ways": (85, ways)}
    assert got_trees(domtree.immediate_dominators(build(spark, some))) == {k: brute_tree(es) for k, (_, es) in some.items()}
    assert trees[0] == trees[-1] == 145 and set(trees[1:-1]) == {85}
    assert max(joins) <= 12


def test_changed_graphs_equal_whole_trees(spark):
    rng = random.Random(11)
    graphs = larger_graphs(12, seed=3)
    added, removed, after = [], [], {}
    for k, (n, es) in graphs.items():
        gone = rng.sample(es, rng.randint(0, 2))
        new = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2))]
        after[k] = [e for e in es if e not in gone] + new
        added += [(k, a, b) for a, b in new]
        removed += [(k, a, b) for a, b in gone]
    before = build(spark, graphs)
    tree = domtree.immediate_dominators(before)
    ends = "graph_id string, src long, dst long"
    plus, minus = spark.createDataFrame(added, ends), spark.createDataFrame(removed, ends)
    cut = before.remove_edges(before.edges.join(minus, ["graph_id", "src", "dst"], "left_semi")).add_edges(plus)
    now, touched = domtree.updated_dominators(tree, cut, plus, minus)
    whole = {k: brute_tree(es) for k, es in after.items()}
    assert got_trees(now) == whole
    counted = {(r["graph_id"], r["node_id"]) for r in touched.collect()}
    old = {k: brute_tree(es) for k, (_, es) in graphs.items()}
    moved = {(k, x) for k, t in old.items() for x in set(t) | set(whole[k]) if t.get(x, (-1,))[0] != whole[k].get(x, (-1,))[0]}
    assert moved <= counted and len(counted) < sum(map(len, whole.values()))


def test_only_the_region_below_a_change_is_computed(spark):
    n = 60
    es = [(i, i + 1) for i in range(n - 1)]
    g = build(spark, {"a": (n, es), "b": (n, es), "c": (n, es)})
    tree = domtree.immediate_dominators(g)
    ends = "graph_id string, src long, dst long"
    plus = spark.createDataFrame([("a", 50, 53), ("b", 50, 20)], ends)  # across, and back to a dominator
    now, touched = domtree.updated_dominators(tree, g.add_edges(plus), plus, spark.createDataFrame([], ends))
    assert {(r["graph_id"], r["node_id"]) for r in touched.collect()} == {("a", i) for i in range(51, 60)}
    assert got_trees(now) == {"a": brute_tree([*es, (50, 53)]), "b": brute_tree([*es, (50, 20)]), "c": brute_tree(es)}
