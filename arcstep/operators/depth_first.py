"""Lexicographic depth-first walks of many small graphs.

No join or window expresses this order, which is sequential by nature. Each graph
is walked in a task of its own; Spark deals the graphs out, and a graph of more than
``MAX_EDGES`` edges is refused before that, not walked slowly. Large graphs have
the breadth-first and set-valued operators of ``traverse``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcstep.operators.graph import Graph
from arcstep.operators.traverse import steps

#: Edges of one graph at most; a task holds 24 bytes of each.
MAX_EDGES = 4_000_000


def _walk(rows: pa.Table) -> pa.Table:
    """The events of one graph's rows (src, dst, out_rank); the root is a row without a target."""
    order = rows.sort_by([("src", "ascending"), ("out_rank", "ascending")])
    after: dict[int, list[int]] = {}
    roots = []
    for a, b in zip(order.column("src").to_pylist(), order.column("dst").to_pylist(), strict=True):
        if b is None:
            roots.append(a)
        else:
            after.setdefault(a, []).append(b)
    out: list[tuple[str, int | None, int]] = []
    state: dict[int, int] = {}  # 1 on the stack, 2 finished
    for root in roots:
        if root in state:
            continue
        state[root] = 1
        out.append(("Discover", None, root))
        stack = [(root, iter(after.get(root, ())))]
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if to not in state:
                    out += [("Tree", at, to), ("Discover", None, to)]
                    state[to] = 1
                    stack.append((to, iter(after.get(to, ()))))
                    break
                out.append(("Back" if state[to] == 1 else "ForwardOrCross", at, to))
            else:
                out.append(("Finish", None, at))
                state[at] = 2
                stack.pop()
    n = len(out)
    return pa.table({
        "graph_id": pa.array([rows.column("graph_id")[0].as_py()] * n, pa.string()), "pos": pa.array(range(n), pa.int64()),
        "event": pa.array([e for e, _, _ in out], pa.string()), "src": pa.array([a for _, a, _ in out], pa.int64()), "node_id": pa.array([b for _, _, b in out], pa.int64()),
    })


def depth_first_events(graph: Graph, seeds: DataFrame, direction: str = "forward") -> DataFrame:
    """(graph_id, pos, event, src, node_id): discoveries, tree, back and other edges, and finishes, in order; seeds by id."""
    large = graph.edge_count().where(F.col("edges") > MAX_EDGES).first()
    if large is not None:
        raise ValueError(f"graph {large['graph_id']} has more than {MAX_EDGES} edges")
    roots = seeds.select("graph_id", F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(-1).cast("long").alias("out_rank"))
    rows = steps(graph, direction).select("graph_id", "src", "dst", "out_rank").unionByName(roots)
    return rows.groupBy("graph_id").applyInArrow(_walk, "graph_id string, pos long, event string, src long, node_id long")


def preorder(events: DataFrame) -> DataFrame:
    """(graph_id, pos, node_id) in the order of discovery; ``pos`` increases, not by one."""
    return events.where("event = 'Discover'").select("graph_id", "pos", "node_id")


def postorder(events: DataFrame) -> DataFrame:
    """(graph_id, pos, node_id) in the order of finishing."""
    return events.where("event = 'Finish'").select("graph_id", "pos", "node_id")


def reverse_postorder(events: DataFrame) -> DataFrame:
    return postorder(events).withColumn("pos", -F.col("pos"))
