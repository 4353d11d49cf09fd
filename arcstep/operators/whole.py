"""Graphs that are solved whole, each by one task, and many small ones at a time.

A walk over a graph takes linear time where its edges lie together; a loop of joins takes
rounds for its depth, each with jobs of its own. So the edges of a graph of up to ``MAX_EDGES``
edges are dealt to one task, as two columns of numbers, and Spark deals the graphs out. A
task takes as many small graphs at a time as have ``CHUNK`` rows, in one numbering. Larger graphs are told apart by
``parted`` and keep the rounds of joins, which hold no graph in one place.

Every kernel takes rows (graph_id, at, src, dst, ...): edges with ``at`` 0, and nodes marked with another number, in src.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcstep.operators.graph import Graph

#: Edges of a graph that one task takes. Graphs of a million edges took 288 MB in a worker, 150 MB more than small ones,
#: and several tasks share an executor.
MAX_EDGES = 1 << 21
#: Rows of small graphs that are solved at a time.
CHUNK = 200_000


def parted(graph: Graph) -> tuple[Graph, Graph | None]:
    """The graphs of up to ``MAX_EDGES`` edges, and the larger ones if there are any."""
    large = [r["graph_id"] for r in graph.edge_count().where(F.col("edges") > MAX_EDGES).select("graph_id").collect()]
    if not large:
        return graph, None
    inside = F.col("graph_id").isin(large)
    part = lambda keep: Graph(graph.nodes.where(keep), graph.edges.where(keep), None if graph.roots is None else graph.roots.where(keep))
    return part(~inside), part(inside)


def of(df: DataFrame, graph: Graph) -> DataFrame:
    """The rows of ``df`` that belong to the graphs of ``graph``, one part of ``parted``."""
    return df.join(graph.live().select("graph_id").distinct(), "graph_id", "left_semi")


def without(df: DataFrame, large: Graph) -> DataFrame:
    """The rows of ``df`` that belong to none of the large graphs."""
    return df.join(large.live().select("graph_id").distinct(), "graph_id", "left_anti")


def both(small: DataFrame, large: DataFrame | None) -> DataFrame:
    return small if large is None else small.unionByName(large)


def edges(graph: Graph, direction: str = "forward", *more: str) -> DataFrame:
    """The rows of a kernel for the live edges in walking direction."""
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return graph.live().select("graph_id", F.lit(0).alias("at"), F.col(a).alias("src"), F.col(b).alias("dst"), *more)


def marks(nodes: DataFrame, at: int = 1, node: str = "node_id") -> DataFrame:
    return nodes.select("graph_id", F.lit(at).alias("at"), F.col(node).alias("src"), F.col(node).alias("dst"))


def solved(rows: DataFrame, kernel: Callable[..., Iterable[dict]], schema: str, keys: Sequence[str] = ("graph_id",), plain: bool = False) -> DataFrame:
    """What ``kernel`` makes of the graphs of ``rows``: tables of columns of ``schema``, which begins with ``keys``.

    It gets a ``Whole``, or the table of the rows themselves if they are ``plain``.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    placed = rows.repartition(parts, *keys).sortWithinPartitions(*keys)
    types = dict(rows.dtypes)
    return placed.mapInArrow(partial(_run, kernel, tuple(keys), plain=plain), ", ".join([f"{k} {types[k]}" for k in keys] + [schema]))


def _run(kernel: Callable[..., Iterable[dict]], keys: tuple[str, ...], batches: Iterator[pa.RecordBatch], plain: bool = False) -> Iterator[pa.RecordBatch]:
    for table in _tables(batches, keys):
        whole = table if plain else Whole(table, keys)
        del table
        for columns in kernel(whole):
            yield from pa.table(columns).to_batches(max_chunksize=100_000)


def _tables(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in the order of ``keys`` as tables of whole graphs, of ``CHUNK`` rows or one graph more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(np.flatnonzero(begins(batch, keys))[-1])
        if cut == 0 and rows >= CHUNK and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield _taken(held)
            rows = 0
        elif cut and rows + cut >= CHUNK:
            held.append(batch.slice(0, cut))
            yield _taken(held)
            batch, rows = batch.slice(cut), 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield _taken(held)


def _taken(held: list[pa.RecordBatch]) -> pa.Table:
    out = pa.Table.from_batches(held)
    held.clear()
    return out


def begins(rows: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row is the first one of its graph."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        column = rows.column(k)
        new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
    return new


class Whole:
    """Whole graphs as one: ``n`` nodes, numbered by graph and id, with edges from ``src`` to ``dst`` and what else the rows have."""

    def __init__(self, table: pa.Table, keys: Sequence[str]) -> None:
        new = begins(table, keys)
        first = pa.array(np.flatnonzero(new))
        self._names = {k: table.column(k).take(first) for k in keys}
        code = np.cumsum(new) - 1
        at = table.column("at").to_numpy()
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        low = min(int(src.min()), int(dst.min()))
        span = max(int(src.max()), int(dst.max())) - low + 1
        if span > (1 << 62) // (int(code[-1]) + 1):  # ids too far apart to be put beside a graph's number
            some = np.unique(np.concatenate([src, dst]))
            src, dst, back = np.searchsorted(some, src), np.searchsorted(some, dst), some
            low, span = 0, len(some)
        else:
            back = None
        a, b = code * span + (src - low), code * span + (dst - low)
        if (int(code[-1]) + 1) * span <= 8 * len(a) + 1024:
            seen = np.zeros((int(code[-1]) + 1) * span, bool)
            seen[a] = seen[b] = True
            places = np.flatnonzero(seen)
            number = np.cumsum(seen, dtype=np.int32) - np.int32(1)
            a, b = number[a], number[b]
            del seen, number
        else:
            places = np.unique(np.concatenate([a, b]))
            a, b = np.searchsorted(places, a).astype(np.int32), np.searchsorted(places, b).astype(np.int32)
        self.n = len(places)
        self.graph = (places // span).astype(np.int32)
        ids = places % span
        self.ids = ids + low if back is None else back[ids]
        edge = at == 0
        whole = bool(edge.all())
        self.src, self.dst = (a, b) if whole else (a[edge], b[edge])
        self._at, self._a = at[~edge], a[~edge]
        more = [c for c in table.column_names if c not in (*keys, "at", "src", "dst")]
        self._edge = None if whole else pa.array(edge)
        self._more = {c: table.column(c) for c in more}

    def column(self, name: str) -> np.ndarray:
        """A further column of the edges."""
        held = self._more[name]
        return (held if self._edge is None else held.filter(self._edge)).to_numpy()

    def marked(self, at: int = 1) -> np.ndarray:
        """The nodes with this mark, in their rows' order."""
        return self._a[self._at == at]

    def marks_of(self, name: str, at: int = 1) -> np.ndarray:
        """A further column of the rows of this mark."""
        held = self._more[name] if self._edge is None else self._more[name].filter(pc.invert(self._edge))
        return held.filter(pa.array(self._at == at)).to_numpy()

    def after(self, backward: bool = False, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each node's edges begin among the sorted ones, their targets, and their places among the given ones."""
        a, b = (self.dst, self.src) if backward else (self.src, self.dst)
        by = np.argsort(a, kind="stable") if order is None else np.lexsort((order, a))
        start = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.bincount(a, minlength=self.n), out=start[1:])
        return start, b[by], by

    def result(self, nodes: np.ndarray, **columns: np.ndarray | pa.Array) -> dict:
        """Columns with the keys of the graphs of ``nodes``."""
        at = pa.array(self.graph[nodes])
        return {k: v.take(at) for k, v in self._names.items()} | columns


# -- kernels ------------------------------------------------------------------


def _spread(start: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all edges of the nodes of ``front``, in its order, and for each the node's place in it."""
    counts = start[front + 1] - start[front]
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(front)), counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[front] - (ends - counts), counts), owner


def _search(n: int, start: np.ndarray, to: np.ndarray, seeds: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes in the order of a breadth-first search, their depths, and the place of the edge that found each and the node it leaves, or -1.

    All graphs advance together; among themselves the nodes of each are in the order of its own search.
    """
    seen, slot = np.zeros(n, bool), np.zeros(n, np.int64)
    front, depth = np.asarray(seeds), 0
    seen[front] = True
    nothing = np.full(len(front), -1, np.int64)
    parts = [(front, np.zeros(len(front), np.int64), nothing, nothing)]
    while len(front) and (most is None or depth < most):
        depth += 1
        place, owner = _spread(start, front)
        new = ~seen[to[place]]
        place, owner = place[new], owner[new]
        found = to[place]
        # Only the first edge into a node counts.
        slot[found[::-1]] = np.arange(len(found))[::-1]
        first = slot[found] == np.arange(len(found))
        place, owner, found = place[first], owner[first], found[first]
        seen[found] = True
        parts.append((found, np.full(len(found), depth, np.int64), place, front[owner].astype(np.int64)))
        front = found
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def reached_kernel(w: Whole) -> Iterator[dict]:
    start, to, _ = w.after()
    nodes, *_ = _search(w.n, start, to, np.unique(w.marked()))
    yield w.result(nodes, node_id=w.ids[nodes])


def depths_kernel(w: Whole, most: int | None = None) -> Iterator[dict]:
    start, to, _ = w.after()
    nodes, depth, *_ = _search(w.n, start, to, np.unique(w.marked()), most)
    yield w.result(nodes, node_id=w.ids[nodes], depth=depth)


def _optional(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~known)


def order_kernel(w: Whole, most: int | None = None) -> Iterator[dict]:
    ids = w.column("edge_id")
    start, to, by = w.after(order=ids)
    nodes, depth, place, parent = _search(w.n, start, to, np.unique(w.marked()), most)
    # Ranks count the nodes of each graph.
    group = w.graph[nodes]
    sort = np.argsort(group, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(group))])[:-1]
    rank = np.empty(len(nodes), np.int64)
    rank[sort] = np.arange(len(nodes)) - begins[group[sort]]
    known = place >= 0
    edge = ids[by[place]] if len(ids) else np.zeros(len(nodes), np.int64)
    yield w.result(nodes, node_id=w.ids[nodes], depth=depth, rank=rank, parent=_optional(w.ids[parent], known), edge_id=_optional(edge, known))


def path_kernel(w: Whole) -> Iterator[dict]:
    """From each goal (mark 2) back to a start (mark 1), by the order of discovery."""
    ids = w.column("edge_id")
    start, to, by = w.after(order=ids)
    nodes, depth, place, parent = _search(w.n, start, to, np.unique(w.marked(1)))
    row = np.full(w.n, -1, np.int64)
    row[nodes] = np.arange(len(nodes))
    taken = np.zeros(len(nodes), bool)
    at = row[np.unique(w.marked(2))]
    at = at[at >= 0]
    while len(at):
        taken[at] = True
        up = parent[at]
        at = row[np.unique(up[up >= 0])]
        at = at[~taken[at]]
    on = np.flatnonzero(taken)
    known = place[on] >= 0
    edge = ids[by[place[on]]] if len(ids) else np.zeros(len(on), np.int64)
    yield w.result(nodes[on], pos=depth[on], node_id=w.ids[nodes[on]], edge_id=_optional(edge, known))


def common_kernel(w: Whole, most: int | None = None) -> Iterator[dict]:
    """Nodes that searches from both marks, 1 and 2, reach."""
    start, to, _ = w.after()
    sides = []
    for mark in (1, 2):
        nodes, depth, *_ = _search(w.n, start, to, np.unique(w.marked(mark)), most)
        far = np.full(w.n, -1, np.int64)
        far[nodes] = depth
        sides.append(far)
    a, b = sides
    nodes = np.flatnonzero((a >= 0) & (b >= 0))
    yield w.result(nodes, node_id=w.ids[nodes], from_a=a[nodes], from_b=b[nodes])


def _strong(w: Whole) -> tuple[array, array, np.ndarray, np.ndarray]:
    """The least node of every node's strong component, and the nodes, component by component, with what a component leads to before it."""
    start, to, _ = w.after()
    begin, goes = memoryview(start), memoryview(np.ascontiguousarray(to))
    n = w.n
    at = array("q", start.tobytes())
    rank, least = array("i", bytes(4 * n)), array("i", b"\xff" * (4 * n))
    ended = array("i")
    open_: list[int] = []
    tops: list[int] = []
    count = 0
    for root in range(n):
        if rank[root]:
            continue
        count += 1
        rank[root] = count
        walk = [root]
        open_.append(root)
        tops.append(root)
        while walk:
            v = walk[-1]
            k, end = at[v], begin[v + 1]
            while k < end:
                x = goes[k]
                k += 1
                if not rank[x]:
                    count += 1
                    rank[x] = count
                    walk.append(x)
                    open_.append(x)
                    tops.append(x)
                    at[v] = k
                    break
                if least[x] < 0:
                    r = rank[x]
                    while rank[tops[-1]] > r:
                        tops.pop()
            else:
                walk.pop()
                if tops[-1] == v:
                    tops.pop()
                    if open_[-1] == v:
                        open_.pop()
                        least[v] = v
                        ended.append(v)
                    else:
                        k = len(open_) - 1
                        while open_[k] != v:
                            k -= 1
                        members = open_[k:]
                        del open_[k:]
                        name = min(members)
                        for x in members:
                            least[x] = name
                        ended.extend(members)
    return least, ended, start, to


def strong_kernel(w: Whole) -> Iterator[dict]:
    """The components of the marked nodes, over edges between them."""
    known = np.zeros(w.n, bool)
    known[w.marked()] = True
    inside = known[w.src] & known[w.dst]
    w.src, w.dst = w.src[inside], w.dst[inside]
    least = np.frombuffer(_strong(w)[0], np.int32)
    nodes = np.flatnonzero(known)
    yield w.result(nodes, node_id=w.ids[nodes], component=w.ids[least[nodes]])


def summaries_kernel(w: Whole) -> Iterator[dict]:
    """The least of the values (of mark 1; mark 2 has a null) of a node and of all that it reaches."""
    least, ended, start, to = _strong(w)
    given = w.marked()
    values = w.marks_of("value")
    none = np.iinfo(np.int64).max
    own = np.full(w.n, none, np.int64)
    np.minimum.at(own, given, values)
    has = np.zeros(w.n, bool)
    has[given] = True
    # Values are compared as numbers from 0 on, so that "none" is above all of them.
    levels, place = np.unique(own[has], return_inverse=True)
    own[has] = place
    best = array("q", own.tobytes())
    begin, goes = memoryview(start), memoryview(np.ascontiguousarray(to))
    members: list[int] = []
    last = len(ended) - 1
    for i, v in enumerate(ended):
        members.append(v)
        name = least[v]
        if i < last and least[ended[i + 1]] == name:
            continue
        low = none
        for x in members:
            if best[x] < low:
                low = best[x]
            for k in range(begin[x], begin[x + 1]):
                y = best[goes[k]]  # what other components lead to is settled
                if y < low:
                    low = y
        for x in members:
            best[x] = low
        members.clear()
    out = np.frombuffer(best, np.int64)
    null = np.zeros(w.n, bool)
    null[w.marked(2)] = True
    nodes = np.flatnonzero((out < none) | null)
    known = out[nodes] < none
    values = np.zeros(len(nodes), np.int64)
    values[known] = levels[out[nodes][known]]
    yield w.result(nodes, node_id=w.ids[nodes], value=_optional(values, known))


def weak_kernel(w: Whole) -> Iterator[dict]:
    """Roots hang below the least one that they are linked with, until no link leads on."""
    top = np.arange(w.n, dtype=np.int32)
    a, b = w.src, w.dst
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := top[top], top):
            top = further
    yield w.result(np.arange(w.n), node=w.ids, component=w.ids[top])


def _dominators(w: Whole, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reached nodes in the preorder of a depth-first walk from a node above ``roots``, and the places of their immediate dominators there.

    Place 0 is the node above. Lengauer and Tarjan's method: semidominators from the last node on, by
    paths that get shorter as they are followed.
    """
    n = w.n
    start, to, _ = w.after()
    begin, goes = memoryview(start), memoryview(np.ascontiguousarray(to))
    number = array("i", bytes(4 * n))
    vertex, parent = array("i", [-1]), array("i", [0])
    at = array("q", start.tobytes())
    for root in roots.tolist():
        if number[root]:
            continue
        number[root] = len(vertex)
        vertex.append(root)
        parent.append(0)
        walk = [root]
        while walk:
            v = walk[-1]
            k, end = at[v], begin[v + 1]
            while k < end:
                x = goes[k]
                k += 1
                if not number[x]:
                    number[x] = len(vertex)
                    vertex.append(x)
                    parent.append(number[v])
                    walk.append(x)
                    at[v] = k
                    break
            else:
                walk.pop()
    del begin, goes, at
    m = len(vertex)
    # What leads to a place, from reached nodes; the node above leads to all roots.
    place = np.frombuffer(number, np.int32)
    a, b = place[w.src], place[w.dst]
    some = (a > 0) & (b > 0) & (a != b)
    tops = place[roots]
    a, b = np.concatenate([a[some], np.zeros(len(tops), np.int32)]), np.concatenate([b[some], tops])
    by = np.argsort(b, kind="stable")
    first = np.zeros(m + 1, np.int64)
    np.cumsum(np.bincount(b, minlength=m), out=first[1:])
    before, begin = memoryview(np.ascontiguousarray(a[by])), memoryview(first)
    semi, label = array("i", range(m)), array("i", range(m))
    above, idom = array("i", b"\xff" * (4 * m)), array("i", bytes(4 * m))
    head, following = array("i", b"\xff" * (4 * m)), array("i", b"\xff" * (4 * m))

    def best(v: int) -> int:
        """The place with the least semidominator on the path linked so far above ``v``."""
        if above[v] < 0:
            return v
        path = []
        x = v
        while above[above[x]] >= 0:
            path.append(x)
            x = above[x]
        for x in reversed(path):
            up = above[x]
            if semi[label[up]] < semi[label[x]]:
                label[x] = label[up]
            above[x] = above[up]
        return label[v]

    for i in range(m - 1, 0, -1):
        low = i
        for k in range(begin[i], begin[i + 1]):
            s = semi[best(before[k])]
            if s < low:
                low = s
        semi[i] = low
        following[i], head[low] = head[low], i
        p = parent[i]
        above[i] = p
        v = head[p]
        while v >= 0:
            u = best(v)
            idom[v] = u if semi[u] < semi[v] else p
            v = following[v]
        head[p] = -1
    depth = array("i", bytes(4 * m))
    for i in range(1, m):
        if idom[i] != semi[i]:
            idom[i] = idom[idom[i]]
        depth[i] = depth[idom[i]] + 1
    return np.frombuffer(vertex, np.int32), np.frombuffer(idom, np.int32), np.frombuffer(depth, np.int32)


def tree_kernel(w: Whole) -> Iterator[dict]:
    """The immediate dominators and depths, from 0 at a root (mark 1)."""
    vertex, idom, depth = _dominators(w, np.unique(w.marked()))
    nodes, up = vertex[1:], idom[1:]
    yield w.result(nodes, node_id=w.ids[nodes], idom=_optional(w.ids[vertex[up]], up > 0), depth=depth[1:].astype(np.int64) - 1)


def dominators_kernel(w: Whole) -> Iterator[dict]:
    """Every node with itself and all its dominators, level by level."""
    vertex, idom, _ = _dominators(w, np.unique(w.marked()))
    low = high = np.arange(1, len(vertex))
    while len(low):
        nodes = vertex[low]
        yield w.result(nodes, node_id=w.ids[nodes], dom=w.ids[vertex[high]])
        high = idom[high]
        low, high = low[high > 0], high[high > 0]
