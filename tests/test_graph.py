"""Graph operators against hand-built graphs and brute force over many random graphs at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arcstep.operators import analysis, components, dominance, graph, transform, traverse

NODES = "graph_id string, node_id long, payload string"
EDGES = "graph_id string, edge_id long, src long, dst long"


def build(spark, graphs: dict[str, tuple[int, list[tuple[int, int]]]]) -> graph.Graph:
    nodes = [(g, i, str(i)) for g, (n, _) in graphs.items() for i in range(n)]
    edges = [(g, k, a, b) for g, (_, es) in graphs.items() for k, (a, b) in enumerate(es)]
    roots = spark.createDataFrame([(g, 0) for g, (n, _) in graphs.items() if n], "graph_id string, root long")
    return graph.Graph(spark.createDataFrame(nodes, NODES), graph.edges_of(spark.createDataFrame(edges, EDGES)), roots)


FIXED = {
    "fork": (4, [(0, 1), (0, 2), (1, 3)]),
    "diamond": (4, [(0, 1), (0, 2), (1, 3), (2, 3)]),
    "cycle_tail": (4, [(0, 1), (1, 2), (2, 1), (2, 3)]),
    "two_cycles": (5, [(0, 1), (1, 2), (2, 0), (1, 3), (3, 4), (4, 3)]),
    "self": (2, [(0, 0)]),
    "apart": (4, [(0, 1), (2, 3)]),
    "alone": (1, []),
    "metrics": (5, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3)]),
}


def random_graphs(k: int) -> dict:
    rng = random.Random(5)
    out = {}
    for i in range(k):
        n = rng.randint(1, 8)
        out[f"r{i}"] = n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    return out


def reach(es, start, without=None):
    seen, todo = set(), [start] if start != without else []
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in es if a == x and b != without]
    return seen


@pytest.fixture(scope="module")
def many():
    return FIXED | random_graphs(30)


@pytest.fixture(scope="module")
def g(spark, many):
    return build(spark, many)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_breadth_first_exact_order(g, many):
    got: dict = {}
    for r in traverse.breadth_first(g, g.roots.withColumnRenamed("root", "node_id")).collect():
        got.setdefault(r["graph_id"], []).append((r["rank"], r["node_id"], r["depth"]))
    for name, (n, es) in many.items():
        order, depth = [0], {0: 0}
        for x in order:
            for a, b in es:
                if a == x and b not in depth:
                    depth[b] = depth[x] + 1
                    order.append(b)
        assert sorted(got[name]) == [(i, x, depth[x]) for i, x in enumerate(order)], name


def test_strong_components(g, many):
    got: dict = {}
    for r in components.strong_components(g).collect():
        got.setdefault(r["graph_id"], {})[r["node_id"]] = r["component"]
    for name, (n, es) in many.items():
        want = {x: min(y for y in range(n) if y in reach(es, x) and x in reach(es, y)) for x in range(n)}
        assert got[name] == want, name


def test_dominators_and_frontier(g, many):
    dom = dominance.dominators(g).cache()
    got = {(r["graph_id"], r["node_id"], r["dom"]) for r in dom.collect()}
    want = set()
    for name, (_, es) in many.items():
        live = reach(es, 0)
        want |= {(name, x, d) for x in live for d in live if x == d or x not in reach(es, 0, without=d)}
    assert got == want
    frontier = {(r["graph_id"], r["node_id"], r["frontier"]) for r in dominance.dominance_frontier(g, dom).collect()}
    expect = set()
    for name, (_, es) in many.items():
        for b in {b for _, b in es if sum(y == b for _, y in es) > 1}:
            strict = {d for (h, x, d) in want if h == name and x == b and d != b}
            for p in {a for a, y in es if y == b}:
                runners = {d for (h, x, d) in want if h == name and x == p} or {p}
                expect |= {(name, d, b) for d in runners - strict}
    assert frontier == expect


def test_natural_loops_and_metrics(spark, g, many):
    dom = dominance.dominators(g)
    backs = dominance.back_edges(g, dom).cache()
    bodies = dominance.loop_bodies(g, backs).cache()
    assert rows(dominance.loops(g, backs, bodies).where("graph_id = 'metrics'"), "header", "size", "depth") == [(3, 2, 0)]
    assert rows(dominance.nesting_depth(g, bodies).where("graph_id = 'metrics'"), "node_id", "depth") == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    m = analysis.graph_metrics(g, bodies).where("graph_id = 'metrics'").first()
    assert (m["nodes"], m["edges"], m["reachable"], m["cyclomatic"]) == (5, 6, 5, 3)
    assert rows(analysis.diamonds(g).where("graph_id = 'diamond'"), "top", "left", "right", "bottom") == [(0, 1, 2, 3)]
    assert rows(analysis.self_loops(g).where("graph_id = 'self'"), "node_id") == [(0,)]


def test_topological_order_only_of_acyclic_graphs(g, many):
    got = {r["graph_id"] for r in traverse.topological_order(g).collect()}
    for name, (n, es) in many.items():
        cyclic = any(x in reach(es, b) for x, b in es)
        assert (name in got) == (not cyclic), name


def test_horn_min_label_and_summaries(spark):
    clauses = spark.createDataFrame([("s", 0, 0), ("s", 1, 1), ("s", 2, 2), ("s", 3, 3), ("s", 4, 4)], "set_id string, clause_id long, head long")
    bodies = spark.createDataFrame(
        [("s", 0, 1), ("s", 0, 2), ("s", 2, 1), ("s", 2, 1), ("s", 3, 0), ("s", 3, 4), ("s", 4, 3)], "set_id string, clause_id long, fact long"
    )
    assert rows(components.horn_derivable(clauses, bodies), "fact") == [(0,), (1,), (2,)]
    g = build(spark, {"x": (5, [(0, 1), (0, 2), (1, 2), (2, 3), (0, 4)])})
    rule = F.when(F.col("edge_id") == 0, F.lit(2)).when(F.col("edge_id") == 1, F.lit(9)).when(F.col("edge_id") == 4, F.lit(None)).otherwise(F.col("label"))
    seeds = spark.createDataFrame([("x", 0, 0)], "graph_id string, node_id long, label long")
    got = components.min_label_relaxation(g, seeds, rule.cast("long"))
    assert rows(got, "node_id", "label") == [(0, 0), (1, 2), (2, 2), (3, 2)]


def test_stored_graph_updates(spark):
    g = build(spark, {"x": (3, [(0, 1), (1, 2), (0, 1)])})
    gone = spark.createDataFrame([("x", 1), ("x", 99)], "graph_id string, edge_id long")
    h = g.remove_edges(gone).remove_edges(gone)
    assert rows(h.live(), "edge_id") == [(0,), (2,)]
    assert h.edge_slots().first()["slots"] == 3
    more = h.add_edges(spark.createDataFrame([("x", 2, 0)], "graph_id string, src long, dst long"))
    assert rows(more.live(), "edge_id", "src", "dst") == [(0, 0, 1), (2, 0, 1), (3, 2, 0)]
    with pytest.raises(ValueError):
        h.add_edges(spark.createDataFrame([("x", 2, 7)], "graph_id string, src long, dst long"))
    assert rows(h.successors(), "node_id", "nodes") == [(0, [1, 1]), (1, []), (2, [])]
    grown = h.add_nodes(spark.createDataFrame([("x", "p"), ("y", "q")], "graph_id string, payload string"))
    assert rows(grown.nodes, "graph_id", "node_id") == [("x", 0), ("x", 1), ("x", 2), ("x", 3), ("y", 0)]


def test_keys(spark):
    seen = spark.createDataFrame([("x", "b", 0), ("x", "a", 1), ("x", "b", 2)], "graph_id string, key string, seen long")
    keys = graph.intern(seen)
    assert rows(keys, "key", "node_id") == [("a", 1), ("b", 0)]
    more = graph.ensure_keys(keys, spark.createDataFrame([("x", "a", 0), ("x", "c", 1)], "graph_id string, key string, seen long"))
    assert rows(more, "key", "node_id") == [("a", 1), ("b", 0), ("c", 2)]
    pairs = spark.createDataFrame([("x", "a", "b"), ("x", "a", "z")], "graph_id string, source_key string, target_key string")
    assert rows(graph.edges_between(more, pairs), "src", "dst") == [(1, 0)]


def test_walks_and_chases(spark):
    g = build(spark, {"x": (5, [(0, 1), (1, 2), (2, 0), (1, 3), (3, 4)])})
    start = spark.createDataFrame([("x", 0)], "graph_id string, node_id long")
    assert rows(traverse.walk_edges(g, start, max_depth=2), "edge_id", "depth") == [(0, 1), (1, 2), (3, 2)]
    assert rows(traverse.walk_edges(g, start, max_depth=0), "edge_id") == []
    assert rows(traverse.walk_edges(g, start, where="dst <> 2"), "edge_id") == [(0,), (3,), (4,)]
    pairs = spark.createDataFrame([("x", 0, 4)], "graph_id string, start long, goal long")
    assert rows(traverse.shortest_path(g, pairs), "pos", "node_id") == [(0, 0), (1, 1), (2, 3), (3, 4)]
    links = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("x", 2, 0)], "graph_id string, node_id long, next long")
    assert rows(traverse.follow(links, start, 10), "hop", "node_id") == [(0, 0), (1, 1), (2, 2)]
    assert rows(traverse.follow(links, start, 1), "hop", "node_id") == [(0, 0), (1, 1)]


def test_greedy_colouring_equals_the_sequential_one(spark):
    rng = random.Random(9)
    pairs, nodes, want = [], [], {}
    for k in range(12):
        n = rng.randint(1, 7)
        es = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 2 * n)) if n > 1}
        name = f"g{k}"
        nodes += [(name, str(i)) for i in range(n)]
        pairs += [(name, str(a), str(b)) for a, b in es]
        near = {i: {b if a == i else a for a, b in es if i in (a, b)} for i in range(n)}
        colour: dict = {}
        for i in sorted(range(n), key=lambda i: (len(near[i]), str(i))):
            taken = {colour[j] for j in near[i] if j in colour}
            colour[i] = next(c for c in range(n) if c not in taken)
        want |= {(name, str(i)): c for i, c in colour.items()}
    got = analysis.colour(spark.createDataFrame(pairs, "graph_id string, a string, b string"), spark.createDataFrame(nodes, "graph_id string, node string"))
    assert {(r["graph_id"], r["node"]): r["colour"] for r in got.collect()} == want


def test_rewrites(spark):
    g = build(spark, {"x": (4, [(0, 1), (0, 2), (1, 2), (2, 3), (1, 3)])})
    cut = transform.split_critical_edges(g)
    assert rows(cut.edges, "edge_id", "src", "dst") == [(0, 0, 1), (1, 0, 4), (2, 1, 5), (3, 2, 3), (4, 1, 6), (5, 4, 2), (6, 5, 2), (7, 6, 3)]
    turned = transform.reverse_rooted(g)
    assert turned.roots.first()["root"] == 3


def test_copies_are_followed_to_the_end_of_long_chains(spark):
    from arcstep.operators import dataflow

    rows = [("g", 0, i, f"v{i}", f"v{i + 1}") for i in range(70)]
    instrs = spark.createDataFrame(rows, "graph_id string, block long, idx long, copy_dst string, copy_src string")
    assert {r["source"] for r in dataflow.copy_targets(instrs).collect()} == {"v70"}
