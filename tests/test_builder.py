"""Graphs from streams, values and depth-first walks against sequential versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from arcstep.operators import builder, depth_first, dominance, frames, graph, traverse, values

STREAM = "graph_id string, seq long, effect string"


def sequential(effects):
    """One stream, instruction by instruction, with a stack of scopes; or the first error."""
    edges, where, scopes, now, count = [], [], [], 0, 1

    def start():
        nonlocal count
        count += 1
        return count - 1

    def inner(*kinds):
        return next((s for s in reversed(scopes) if s["kind"] in kinds), None)

    for at, e in enumerate(effects):
        kind = builder.OPENS.get(e) or builder.INNER.get(e) or builder.CLOSES.get(e)
        if e in builder.INNER or e in builder.CLOSES:
            if not scopes or scopes[-1]["kind"] != kind:
                return (at, builder.ERRORS[e], 0)
            s = scopes[-1]
        if e in ("Break", "ConditionalBreak") and not inner("Loop", "Switch") or e in ("Continue", "ConditionalContinue") and not inner("Loop"):
            return (at, builder.ERRORS[e], 0)
        if e in builder.CLOSES:
            scopes.pop()
            if kind == "Loop":
                edges.append((now, s["header"], "Back"))
            after = start()
            if kind != "Loop":
                edges += [(x, after, "Fallthrough") for x in (*s["arms"], now)]
            if kind == "If" and not s["arms"]:
                edges.append((s["pre"], after, "ConditionalFalse"))
            edges += [(x, after, "Unconditional") for x in s["breaks"]]
            now = after
            continue
        if e in builder.INNER:
            s["arms"].append(now)
            now = start()
            edges.append((s["pre"], now, "ConditionalFalse" if kind == "If" else "SwitchCase"))
        elif e == "Label":
            before, now = now, start()
            edges.append((before, now, "Fallthrough"))
        where.append((at, now))
        if e in builder.OPENS:
            before, now = now, start()
            edges.append((before, now, {"If": "ConditionalTrue", "Switch": "SwitchCase", "Loop": "Fallthrough"}[kind]))
            scopes.append({"kind": kind, "pre": before, "header": now, "arms": [], "breaks": []})
        elif e == "Break":
            inner("Loop", "Switch")["breaks"].append(now)
            now = start()
        elif e in ("ConditionalBreak", "ConditionalReturn"):
            before, side, now = now, start(), start()
            edges += [(before, side, "ConditionalTrue"), (before, now, "ConditionalFalse")]
            if e == "ConditionalBreak":
                inner("Loop", "Switch")["breaks"].append(side)
        elif e == "Continue":
            edges.append((now, inner("Loop")["header"], "Back"))
            now = start()
        elif e == "ConditionalContinue":
            before, now = now, start()
            edges += [(before, inner("Loop")["header"], "ConditionalTrue"), (before, now, "ConditionalFalse")]
        elif e == "ConditionalJump":
            before, now = now, start()
            edges.append((before, now, "ConditionalFalse"))
        elif e in ("Return", "Terminate", "Jump", "IndirectJump"):
            now = start()
    if scopes:
        return (None, "UnclosedScopes", len(scopes))
    while count > 1 and all(b != count - 1 for _, b in where) and all(b != count - 1 for _, b, _ in edges):
        count -= 1
    return [x for x in edges if x[0] < count], where, count


def test_streams_equal_the_sequential_builder(spark):
    rng = random.Random(1)
    plain = ["Fallthrough", "Call", "Return", "Jump", "Label", "ConditionalJump", "ConditionalReturn", "Break", "ConditionalBreak", "Continue", "ConditionalContinue"]
    streams = {"empty_if": ["ConditionalOpen", "ConditionalClose"], "dead": ["LoopOpen", "Continue", "LoopClose"], "else": ["ConditionalAlternate"], "crossed": ["LoopOpen", "ConditionalOpen", "LoopClose"]}
    for k in range(120):
        out, open_ = [], []
        for _ in range(rng.randint(1, 25)):
            x = rng.random()
            if x < 0.25:
                open_.append(rng.choice(list(builder.OPENS)))
                out.append(open_[-1])
            elif x < 0.45 and open_:
                out.append({v: c for c, v in builder.CLOSES.items()}[builder.OPENS[open_.pop()]])
            elif x < 0.6 and open_:
                out.append({"If": "ConditionalAlternate", "Switch": "SwitchCase", "Loop": "Fallthrough"}[builder.OPENS[open_[-1]]])
            else:
                out.append(rng.choice(plain if open_ or k % 3 == 0 else plain[:7]))
        if k % 4:
            out += [{v: c for c, v in builder.CLOSES.items()}[builder.OPENS[x]] for x in reversed(open_)]
        streams[f"s{k}"] = out
    rows = spark.createDataFrame([(g, i, e) for g, es in streams.items() for i, e in enumerate(es)], STREAM).repartition(4)
    built = builder.build(rows)
    edges, where, nodes, errors = {}, {}, {}, {}
    for r in built.graph.live().orderBy("graph_id", "edge_id").collect():
        edges.setdefault(r["graph_id"], []).append((r["src"], r["dst"], r["kind"]))
    for r in built.instructions.orderBy("graph_id", "seq").collect():
        where.setdefault(r["graph_id"], []).append((r["seq"], r["block"]))
    for r in built.graph.nodes.collect():
        nodes[r["graph_id"]] = nodes.get(r["graph_id"], 0) + 1
    for r in built.errors.collect():
        errors[r["graph_id"]] = (r["seq"], r["error"], r["remaining"])
    for g, es in streams.items():
        want = sequential(es)
        if isinstance(want[1], str):
            assert errors[g] == want, g
            assert g not in nodes
        else:
            assert (edges.get(g, []), where.get(g, []), nodes[g]) == want, (g, es)
    assert len(errors) > 10 and len(nodes) > 40


def test_depth_first_events(spark):
    rng = random.Random(2)
    graphs = {f"g{k}": (n := rng.randint(1, 9), [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 20))]) for k in range(25)}
    nodes = spark.createDataFrame([(g, i, None) for g, (n, _) in graphs.items() for i in range(n)], "graph_id string, node_id long, payload string")
    edges = spark.createDataFrame([(g, k, a, b) for g, (_, es) in graphs.items() for k, (a, b) in enumerate(es)], "graph_id string, edge_id long, src long, dst long")
    g = graph.Graph(nodes, graph.edges_of(edges))
    events: dict = {}
    for r in depth_first.depth_first_events(g, nodes.where("node_id = 0")).orderBy("graph_id", "pos").collect():
        events.setdefault(r["graph_id"], []).append((r["event"], r["src"], r["node_id"]))

    def walk(es, at, seen, done, out):
        out.append(("Discover", None, at))
        seen.add(at)
        for a, b in es:
            if a == at:
                if b not in seen:
                    out.append(("Tree", a, b))
                    walk(es, b, seen, done, out)
                else:
                    out.append(("ForwardOrCross" if b in done else "Back", a, b))
        done.add(at)
        out.append(("Finish", None, at))
        return out

    assert events == {k: walk(es, 0, set(), set(), []) for k, (_, es) in graphs.items()}


def test_values_equal_the_sequential_numbering(spark):
    rng = random.Random(3)
    ops = ["add", "mul", None]
    programs = {f"p{k}": [[(rng.choice(ops), [rng.choice("abc") for _ in range(rng.randint(0, 2))], rng.choice("abc")) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 6))] for k in range(15)}
    parents = {g: [None, *(rng.randrange(i) for i in range(1, len(p)))] for g, p in programs.items()}
    rows = [(g, b, i, u, [d], op) for g, p in programs.items() for b, block in enumerate(p) for i, (op, u, d) in enumerate(block)]
    ins = spark.createDataFrame(rows, "graph_id string, block long, idx long, uses array<string>, defs array<string>, op string")
    nodes = spark.createDataFrame([(g, b, None) for g, p in programs.items() for b in range(len(p))], "graph_id string, node_id long, payload string")
    edges = spark.createDataFrame([(g, b - 1, q, b) for g, ps in parents.items() for b, q in enumerate(ps) if b], "graph_id string, edge_id long, src long, dst long")
    roots = spark.createDataFrame([(g, 0) for g in programs], "graph_id string, root long")
    dom = dominance.dominators(graph.Graph(nodes, graph.edges_of(edges), roots))
    names = values.value_names(ins, values.operand_sources(ins, dom))
    got = {tuple(r) for r in values.redundant(ins, names, dom).collect()}
    want = set()

    def number(g, b, held, known):
        held, known = dict(held), set(known)
        for i, (op, uses, d) in enumerate(programs[g][b]):
            value = (op, *(held.get(v, ("entry", v)) for v in uses)) if op else ("site", b, i)
            if op and value in known:
                want.add((g, b, i))
            known.add(value)
            held[d] = value
        for c, q in enumerate(parents[g]):
            if q == b:
                number(g, c, held, known)

    for g in programs:
        number(g, 0, {}, set())
    assert got == want and len(want) > 5
    left = values.eliminate(ins, values.redundant(ins, names, dom))
    assert left.count() == len(rows) - len(want)
    assert left.groupBy("graph_id", "block").agg((F.max("idx") + 1 - F.count(F.lit(1))).alias("gap")).where("gap <> 0").count() == 0


def test_chases_end_where_chains_do(spark):
    rng = random.Random(4)
    nxt = {i: i + 1 for i in range(70)} | {100: 101, 101: 102, 102: 100, 103: 100} | {200 + i: rng.randrange(71) for i in range(30)}
    links = spark.createDataFrame([("g", a, b) for a, b in nxt.items()], "graph_id string, node_id long, next long")
    got = {r["node_id"]: (r["end"], r["hops"]) for r in traverse.chase(links).collect()}
    want = {}
    for a in nxt:
        at, hops = a, 0
        while at in nxt and hops < 500:
            at, hops = nxt[at], hops + 1
        if hops < 500:
            want[a] = at, hops
    assert got == want
    assert traverse.chase(links.limit(0)).count() == 0


def test_size_estimates_stay_bounded_over_many_rounds(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    for _ in range(40):
        last, rows = rows, frames.checkpoint(rows.join(rows.withColumnRenamed("x", "y"), "id").select("id", "x"))
        frames.discard(last)
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    assert rows.count() == 100
