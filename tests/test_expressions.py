"""Expression trees of hand-made blocks and of a long chain."""

from __future__ import annotations

from arcstep.operators import expressions

SCHEMA = "graph_id string, block long, idx long, uses array<string>, defs array<string>, constant long, operator string"


def trees(spark, blocks):
    rows = [(g, 0, i, *x) for g, lines in blocks.items() for i, x in enumerate(lines)]
    out: dict = {}
    for r in expressions.expression_trees(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["graph_id"], set()).add((r["variable"], r["depth"], r["nodes"], r["text"]))
    return out


def op(name, target, *reads):
    return list(reads), [target], None, name


def load(target, value):
    return [], [target], value, None


def call(targets, *reads):
    return list(reads), list(targets), None, None


def test_trees_of_blocks(spark):
    chain = [load("v0", 7)] + [op("inc", f"v{i + 1}", f"v{i}") for i in range(200)]
    got = trees(spark, {
        "nested": [op("mul", "t0", "r1", "r2"), op("add", "t1", "r0", "t0")],
        "constant": [load("t0", 42), op("add", "t1", "r0", "t0")],
        "twice": [op("mul", "t0", "r1", "r2"), op("add", "t1", "t0", "t0"), op("neg", "t2", "t1")],
        "two reads": [op("mul", "t0", "a", "b"), op("f", "x", "t0"), op("g", "y", "t0")],
        "overwritten": [load("a", 1), load("a", 2), op("f", "b", "a"), op("g", "c", "d"), load("c", 5)],
        "itself": [load("n", 1), op("inc", "n", "n")],
        "opaque": [call(["p", "q"], "z"), op("f", "r", "p"), call([], "r"), call(["s"])],
        "read before": [op("f", "b", "a"), load("a", 1)],
        "no operands": [op("now", "t"), op("f", "u", "t", "k")],
        "dropped": [load("a", 1), op("f", "b", "a"), load("b", 2)],
        "chain": chain,
    })
    assert got.pop("chain") == {("v200", 201, 201, "inc(" * 200 + "7" + ")" * 200)}
    assert got == {
        "nested": {("t1", 3, 5, "add(r0,mul(r1,r2))")},
        "constant": {("t1", 2, 3, "add(r0,42)")},
        "twice": {("t0", 2, 3, "mul(r1,r2)"), ("t2", 3, 4, "neg(add(t0,t0))")},
        "two reads": {("t0", 2, 3, "mul(a,b)"), ("x", 2, 2, "f(t0)"), ("y", 2, 2, "g(t0)")},
        "overwritten": {("b", 2, 2, "f(2)"), ("c", 1, 1, "5")},
        "itself": {("n", 2, 2, "inc(1)")},
        "opaque": {("q", 1, 1, "?0"), ("r", 2, 2, "f(?0)"), ("s", 1, 1, "?3")},
        "read before": {("b", 2, 2, "f(a)"), ("a", 1, 1, "1")},
        "no operands": {("u", 2, 3, "f(now(),k)")},
        "dropped": {("b", 1, 1, "2")},
    }


def test_no_instructions(spark):
    assert expressions.expression_trees(spark.createDataFrame([], SCHEMA)).count() == 0
