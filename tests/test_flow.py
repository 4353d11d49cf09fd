"""Conditional constants and keyed fixpoints on hand-made programs and against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcstep.operators import analysis, dataflow, dominance, frames, graph, sccp, solver
from tests.test_graph import build, reach

INSTRS = "graph_id string, block long, idx long, uses array<string>, defs array<string>, op string, value long"


def program(spark, edges, kinds, lines):
    """A graph whose edges have kinds, and instructions (block, op, target, operand, constant)."""
    g = build(spark, {"p": (1 + max(max(e) for e in edges), edges)})
    named = spark.createDataFrame([("p", k, kind) for k, kind in enumerate(kinds)], "graph_id string, edge_id long, k string")
    g = graph.Graph(g.nodes, g.edges.join(named, ["graph_id", "edge_id"]).withColumn("kind", F.col("k")).select(*graph.EDGE_COLUMNS), g.roots)
    count: dict = {}
    rows = []
    for block, op, target, operand, constant in lines:
        count[block] = count.get(block, -1) + 1
        rows.append(("p", block, count[block], [operand] if operand else [], [target] if target else [], op, constant))
    return g, spark.createDataFrame(rows, INSTRS)


def fold(known):
    read = known[F.get("uses", F.lit(0))]
    value = F.when(F.col("op") == "load", F.col("value")).when(F.col("op") == "add", read + F.col("value"))
    return F.when(value.isNotNull(), F.struct(F.get("defs", F.lit(0)).alias("variable"), value.alias("value")))


def test_constants_through_folding_and_dead_branches(spark):
    # 0: c = 1, x = 4; if c: 1: y = x + 1, else 2: y = 9 (never); 3: z = y + 1; w = y read from outside; loop 3 -> 3 with n = n + 1.
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 3), (3, 4)]
    kinds = ["ConditionalTrue", "ConditionalFalse", "Fallthrough", "Fallthrough", "Back", "Fallthrough"]
    lines = [
        (0, "load", "c", None, 1), (0, "load", "x", None, 4), (0, "load", "n", None, 0), (1, "add", "y", "x", 1), (2, "load", "y", None, 9), (3, "add", "z", "y", 1), (3, "add", "n", "n", 1),
        (4, "add", "u", "outside", 1), (4, "call", "v", "z", 0),
    ]
    g, ins = program(spark, edges, kinds, lines)
    dom = dominance.dominators(g).cache()
    phis = dataflow.place_phis(g, ins, dom).cache()
    defs = dataflow.ssa_definitions(ins, phis, dom).cache()
    uses, operands = dataflow.ssa_uses(ins, defs, dom), dataflow.phi_operands(g, phis, defs, dom)
    at = {(r["variable"], r["version"]): (r["block"], r["is_phi"]) for r in defs.collect()}

    def found(**more):
        values, out = sccp.sccp(g, ins, defs, uses, operands, fold, **more)
        return {(v["variable"], *at[v["variable"], v["version"]]): v["value"] if v["state"] == "CONST" else "varies" for v in values.collect()}, {(r["src"], r["dst"]) for r in out.collect()}

    values, out = found()
    assert out == set(edges)
    assert values["y", 1, False] == 5 and values["y", 3, True] == "varies" and values["z", 3, False] == "varies"
    assert values["n", 3, True] == "varies" and values["n", 3, False] == "varies" and values["u", 4, False] == "varies" and values["v", 4, False] == "varies"
    # Flow-insensitive folding of nothing, as in ``constants``, does not know y behind block 1.
    plain = dataflow.constants(g, ins.withColumn("value", F.when(F.col("op") == "load", F.col("value"))))
    assert plain.where("block = 3 and variable = 'y'").first()["state"] == "BOTTOM"
    # With the branch on c, block 2 is never entered and y and z are known.
    tests = defs.where("variable = 'c' and block = 0").select("graph_id", "block", "variable", "version")
    takes = (F.col("kind") == "ConditionalTrue") == (F.col("value") != 0)
    values, out = found(tests=tests, takes=takes)
    assert out == set(edges) - {(0, 2), (2, 3)} and ("y", 2, False) not in values
    assert values["y", 3, True] == 5 and values["z", 3, False] == 6 and values["n", 3, True] == "varies"


def test_reaching_definitions_and_widening_by_the_solver(spark):
    edges = [(0, 1), (1, 2), (2, 1), (1, 3), (4, 3)]
    g, ins = program(spark, edges, ["Fallthrough"] * 5, [(0, "load", "x", None, 1), (1, "use", None, "x", 0), (2, "load", "x", None, 2), (3, "use", None, "x", 0), (4, "load", "y", None, 1)])
    want = {tuple(r) for r in dataflow.reaching_definitions(g, ins).select("side", "block", "def_block", "def_idx", "variable").collect()}
    last = dataflow.definitions(ins).groupBy("graph_id", F.col("block").alias("node_id"), "variable").agg(F.max("idx").alias("i"))
    # A definition is a key; what kills it is every definition of its variable in a block.
    keyed = last.select("graph_id", "variable", F.col("node_id").alias("def_block"), "i", F.concat_ws(":", F.col("node_id").cast("string"), F.col("i").cast("string"), "variable").alias("key")).cache()
    gen = keyed.select("graph_id", F.col("def_block").alias("node_id"), "key", F.lit(True).alias("fact"))
    kill = last.select("graph_id", "node_id", "variable").join(keyed, ["graph_id", "variable"]).select("graph_id", "node_id", "key")
    into, out = solver.solve_keyed(g, solver.gen_kill(gen, kill), F.max)
    got = {(side, r["node_id"], int(r["key"].split(":")[0]), int(r["key"].split(":")[1]), r["key"].split(":")[2]) for side, df in (("in", into), ("out", out)) for r in df.collect()}
    assert got == want

    # Ranges of a counter that a loop raises: without widening they would grow for ever.
    start = spark.createDataFrame([("p", 0, "n", (0, 0))], "graph_id string, node_id long, key string, fact struct<lo: bigint, hi: bigint>")
    rise = lambda nodes, facts: facts.withColumn("fact", F.struct(F.col("fact.lo").alias("lo"), F.when(F.col("node_id") == 2, F.col("fact.hi") + 1).otherwise(F.col("fact.hi")).alias("hi")))
    hull = lambda c: F.struct(F.min(F.col(c)["lo"]).alias("lo"), F.max(F.col(c)["hi"]).alias("hi"))
    top = 1 << 40
    widen = lambda old, new: F.struct(F.least(old["lo"], new["lo"]).alias("lo"), F.when(new["hi"] > old["hi"], F.lit(top).cast("long")).otherwise(old["hi"]).alias("hi"))
    clipped = lambda nodes, facts: rise(nodes, facts).withColumn("fact", F.struct(F.col("fact.lo").alias("lo"), F.least(F.col("fact.hi"), F.lit(top)).alias("hi")))
    _, out = solver.solve_keyed(g, clipped, hull, boundary=start, widen=widen, widen_after=4, types=("string", "struct<lo: bigint, hi: bigint>"))
    assert {r["node_id"]: tuple(r["fact"]) for r in out.collect()} == {0: (0, 0), 1: (0, top), 2: (0, top), 3: (0, top)}

    # Only what the seeds reach is visited.
    into, out = solver.solve_keyed(g, lambda nodes, facts: facts, F.max, boundary=spark.createDataFrame([("p", 2, "t", True)], "graph_id string, node_id long, key string, fact boolean"), seeds=spark.createDataFrame([("p", 2)], "graph_id string, node_id long"))
    assert {r["node_id"] for r in out.collect()} == reach(edges, 2)


def test_keyed_facts_look_up_only_what_a_round_visits(spark, monkeypatch):
    # A chain down which a fact falls: each round visits one node, so all rounds together ask for few rows; tables lie in buckets.
    for module in (frames, solver):
        monkeypatch.setattr(module, "LARGE", 2)
    n, asked, rows = 14, [], solver._Parts.rows
    monkeypatch.setattr(solver._Parts, "rows", lambda self, *nodes: (asked.append(rows(self, *nodes).count() if nodes else None), rows(self, *nodes))[1])
    g = build(spark, {"p": (n, [(i, i + 1) for i in range(n - 1)])})
    start = spark.createDataFrame([("p", 0, "k", 0)], "graph_id string, node_id long, key string, fact long")
    step = lambda nodes, facts: facts.withColumn("fact", F.col("fact") + 1)
    _, out = solver.solve_keyed(g, step, F.min, "forward", boundary=start, seeds=start.select("graph_id", "node_id"), types=("string", "bigint"))
    assert {r["node_id"]: r["fact"] for r in out.collect()} == {i: i + 1 for i in range(n)}
    assert asked[-1] is None and None not in asked[:-1] and max(asked[:-1]) <= 4


def test_pairs_at_points_are_reduced_before_they_move(spark):
    # 40 graphs of 8 blocks of two instructions: 12 variables are live through each block, p up to its first instruction, q from the second.
    live = spark.range(320).selectExpr("cast(id div 8 as string) as graph_id", "id % 8 as block", "explode(transform(sequence(10, 21), x -> concat('v', x))) as variable", "'out' as side")
    lines = [(str(g), b, i, uses, defs, None, None) for g in range(40) for b in range(8) for i, (uses, defs) in enumerate([(["p"], []), ([], ["q"])])]
    status = spark.sparkContext._jsc.sc().statusStore()

    def ran():
        """Records that each stage so far wrote for shuffles."""
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = ran()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task has all of so small a table
    try:
        got = {tuple(r) for r in analysis.interference_at_points(spark.createDataFrame(lines, INSTRS), frames.checkpoint(live)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    vs = [f"v{k}" for k in range(10, 22)]
    pairs = {(a, b) for a in vs for b in vs if a < b} | {(x, v) for v in vs for x in "pq"}
    assert got == {(str(g), *p) for g in range(40) for p in pairs}
    # The ranges of all blocks are 8,320 rows here; pairs of single blocks would be 12,974, as a graph's blocks lie in several tasks.
    assert max(n for s, n in ran().items() if s not in before) < 10_000
