"""The graph model: keyed DataFrames for nodes, edges and roots, and the stored-graph operators.

A ``Graph`` holds many graphs at once, told apart by ``graph_id``. Edges are a
multigraph: parallel and self edges stay. Removing an edge leaves a tombstone
(``live`` false), so ids never change. Adjacency order is the order of edge ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.frames import checkpoint, dense_ids

#: The kinds of control-flow edges.
EDGE_KINDS = (
    "Fallthrough", "ConditionalTrue", "ConditionalFalse", "Unconditional", "Back", "Jump", "IndirectJump", "SwitchCase",
    "Call", "CallReturn", "ExceptionHandler", "ExceptionUnwind", "ExceptionLeave", "IndirectCall",
)

NODE_COLUMNS = ("graph_id", "node_id", "payload")
EDGE_COLUMNS = ("graph_id", "edge_id", "src", "dst", "kind", "weight", "live")


def edges_of(df: DataFrame) -> DataFrame:
    """Fills the optional edge columns: kind, weight and live."""
    for name, value in (("kind", F.lit("Fallthrough")), ("weight", F.lit(None).cast("double")), ("live", F.lit(True))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(*EDGE_COLUMNS)


@dataclass(frozen=True)
class Graph:
    """nodes (graph_id, node_id, payload), edges (EDGE_COLUMNS) and roots (graph_id, root)."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame | None = None

    # -- growth ---------------------------------------------------------------

    def add_nodes(self, payloads: DataFrame) -> Graph:
        """Appends (graph_id, payload) rows; ids go on from each graph's node count, in payload order."""
        count = self.nodes.groupBy("graph_id").agg((F.max("node_id") + 1).alias("n"))
        numbered = dense_ids(payloads.select("graph_id", "payload"), ["payload"], "k", ["graph_id"])
        new = numbered.join(count, "graph_id", "left").select("graph_id", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("long").alias("node_id"), "payload")
        return replace(self, nodes=self.nodes.unionByName(new))

    def invalid_edges(self, pairs: DataFrame) -> DataFrame:
        """The given (graph_id, src, dst) rows with an end that is no node."""
        ids = self.nodes.select("graph_id", "node_id")
        known = pairs.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(
            ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"
        )
        return pairs.exceptAll(known.select(*pairs.columns))

    def add_edges(self, pairs: DataFrame, check: bool = True) -> Graph:
        """Appends (graph_id, src, dst[, kind, weight]) rows with new ids; unknown ends are an error."""
        if check and not self.invalid_edges(pairs.select("graph_id", "src", "dst")).isEmpty():
            raise ValueError("an edge's end is not a node")
        slots = self.edge_slots().withColumnRenamed("slots", "n")
        order = [c for c in ("src", "dst", "kind", "weight") if c in pairs.columns]
        new = dense_ids(pairs, order, "k", ["graph_id"]).join(slots, "graph_id", "left").withColumn("edge_id", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("long"))
        return replace(self, edges=self.edges.unionByName(edges_of(new.drop("n", "k"))))

    def remove_edges(self, ids: DataFrame) -> Graph:
        """Tombstones (graph_id, edge_id) rows; edges that are dead or unknown stay as they are."""
        gone = ids.select("graph_id", "edge_id").distinct().withColumn("gone", F.lit(True))
        edges = self.edges.join(gone, ["graph_id", "edge_id"], "left").withColumn("live", F.col("live") & F.col("gone").isNull())
        return replace(self, edges=edges.select(*EDGE_COLUMNS))

    def set_weight(self, ids: DataFrame) -> Graph:
        """Sets the weight of (graph_id, edge_id, weight) rows; a null clears it."""
        new = ids.select("graph_id", "edge_id", F.col("weight").alias("w"), F.lit(True).alias("hit"))
        edges = self.edges.join(new, ["graph_id", "edge_id"], "left").withColumn("weight", F.when(F.col("hit"), F.col("w")).otherwise(F.col("weight")))
        return replace(self, edges=edges.select(*EDGE_COLUMNS))

    # -- views ----------------------------------------------------------------

    def live(self) -> DataFrame:
        """Live edges."""
        return self.edges.where("live")

    def edge_count(self) -> DataFrame:
        """Live edges by graph."""
        return self.live().groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))

    def edge_slots(self) -> DataFrame:
        """Edge ids ever given by graph, tombstones included."""
        return self.edges.groupBy("graph_id").agg((F.max("edge_id") + 1).alias("slots"))

    def node_count(self) -> DataFrame:
        return self.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))

    def ranked(self) -> DataFrame:
        """Live edges with out_rank and in_rank, their places in the ends' adjacency lists."""
        rank = lambda end: (F.row_number().over(W.partitionBy("graph_id", end).orderBy("edge_id")) - 1).cast("long")
        return self.live().withColumn("out_rank", rank("src")).withColumn("in_rank", rank("dst"))

    def outgoing(self) -> DataFrame:
        """Edge ids leaving each node, in adjacency order (graph_id, node_id, edge_ids)."""
        return self._adjacent("src", "edge_id", "edge_ids")

    def incoming(self) -> DataFrame:
        return self._adjacent("dst", "edge_id", "edge_ids")

    def successors(self) -> DataFrame:
        """Targets of each node in adjacency order, parallel ones kept (graph_id, node_id, nodes)."""
        return self._adjacent("src", "dst", "nodes")

    def predecessors(self) -> DataFrame:
        return self._adjacent("dst", "src", "nodes")

    def _adjacent(self, end: str, value: str, name: str) -> DataFrame:
        lists = self.live().groupBy("graph_id", F.col(end).alias("node_id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("edge_id", F.col(value).alias("v")))), lambda x: x["v"]).alias(name)
        )
        joined = self.nodes.select("graph_id", "node_id").join(lists, ["graph_id", "node_id"], "left")
        return joined.withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))

    def exits(self) -> DataFrame:
        """Nodes without outgoing edges (graph_id, node_id)."""
        return self.nodes.select("graph_id", "node_id").join(
            self.live().select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_anti"
        )

    def find_payload(self, wanted: DataFrame) -> DataFrame:
        """(graph_id, payload, node_id) of the nodes with a wanted (graph_id, payload), such as a function's identity."""
        return self.nodes.join(wanted, ["graph_id", "payload"]).select("graph_id", "payload", "node_id")

    def rooted(self, roots: DataFrame) -> Graph:
        """The same graph with (graph_id, root) rows."""
        return replace(self, roots=roots.select("graph_id", "root"))

    def reversed(self) -> Graph:
        """Every edge turned round; ids stay."""
        turned = self.edges.select("graph_id", "edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight", "live")
        return replace(self, edges=turned)

    def redirect(self, moves: DataFrame) -> Graph:
        """Retargets the edges into ``old`` to ``new`` (graph_id, old, new)."""
        m = moves.select("graph_id", F.col("old").alias("dst"), F.col("new").alias("to"))
        edges = self.edges.join(m, ["graph_id", "dst"], "left").withColumn("dst", F.when(F.col("live") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("dst")))
        return replace(self, edges=edges.select(*EDGE_COLUMNS))

    def subgraph(self, chosen: DataFrame) -> Graph:
        """Induced subgraph of (graph_id, pos, node_id): ids follow ``pos``, the first is the root; weights stay."""
        ids = checkpoint(dense_ids(chosen.select("graph_id", "node_id", "pos"), ["pos"], "new", ["graph_id"]).select("graph_id", "node_id", "new"))
        nodes = self.nodes.join(ids, ["graph_id", "node_id"]).select("graph_id", F.col("new").alias("node_id"), "payload")
        end = lambda c, n: ids.select("graph_id", F.col("node_id").alias(c), F.col("new").alias(n))
        inner = self.live().join(end("src", "a"), ["graph_id", "src"]).join(end("dst", "b"), ["graph_id", "dst"])
        numbered = dense_ids(inner.select("graph_id", "edge_id", "a", "b", "kind", "weight", "live"), ["a", "edge_id"], "k", ["graph_id"])
        edges = numbered.select("graph_id", F.col("k").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "weight", "live")
        return Graph(nodes, edges, ids.where("new = 0").select("graph_id", F.col("new").alias("root")))


# -- keys ---------------------------------------------------------------------


def intern(keys: DataFrame, order: Sequence[str] = ("seen",)) -> DataFrame:
    """(graph_id, key, node_id): dense ids in the order in which keys were first seen."""
    first = keys.groupBy("graph_id", "key").agg(F.min(F.struct(*order)).alias("first"))
    return dense_ids(first, ["first", "key"], "node_id", ["graph_id"]).select("graph_id", "key", "node_id")


def ensure_keys(known: DataFrame, more: DataFrame) -> DataFrame:
    """Adds unknown keys (graph_id, key, seen) behind the known ones; known keys keep their ids."""
    fresh = intern(more.join(known, ["graph_id", "key"], "left_anti"))
    count = known.groupBy("graph_id").agg((F.max("node_id") + 1).alias("n"))
    fresh = fresh.join(count, "graph_id", "left").select("graph_id", "key", (F.col("node_id") + F.coalesce("n", F.lit(0))).alias("node_id"))
    return known.unionByName(fresh)


def edges_between(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, src, dst) of (graph_id, source_key, target_key) rows whose keys are both known."""
    end = lambda k, n: keys.select("graph_id", F.col("key").alias(k), F.col("node_id").alias(n))
    return pairs.join(end("source_key", "src"), ["graph_id", "source_key"]).join(end("target_key", "dst"), ["graph_id", "target_key"]).select("graph_id", "src", "dst")


def keyed_graph(keys: DataFrame, pairs: DataFrame) -> tuple[Graph, DataFrame]:
    """A graph whose payloads are its keys, and its key table."""
    nodes = keys.select("graph_id", "node_id", F.col("key").alias("payload"))
    ends = edges_between(keys, pairs)
    return Graph(nodes, edges_of(dense_ids(ends, ["src", "dst"], "edge_id", ["graph_id"]))), keys


# -- text output --------------------------------------------------------------


def to_dot(graph: Graph, label: Column | None = None) -> DataFrame:
    """(graph_id, dot): Graphviz text; lines are ordered by node, then by edge."""
    text = F.coalesce(label if label is not None else F.col("payload"), F.lit(""))
    nodes = graph.nodes.select("graph_id", F.struct(F.lit(0).alias("k"), F.col("node_id").alias("i"), F.format_string('  n%d [label="%s"];', "node_id", text).alias("s")).alias("line"))
    style = F.when(F.col("kind") == "ConditionalTrue", "green").when(F.col("kind") == "ConditionalFalse", "red").when(F.col("kind") == "Back", "blue").otherwise("black")
    weight = F.when(F.col("weight").isNull(), "").otherwise(F.format_string(' label="(%.2f)" penwidth=%.2f', "weight", 1 + 3 * F.coalesce("weight", F.lit(0.0))))
    edges = graph.live().select(
        "graph_id", F.struct(F.lit(1).alias("k"), F.col("edge_id").alias("i"), F.format_string("  n%d -> n%d [color=%s%s];", "src", "dst", style, weight).alias("s")).alias("line")
    )
    lines = nodes.unionByName(edges).groupBy("graph_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select("graph_id", F.concat(F.lit("digraph {\n"), F.array_join(F.col("lines.s"), "\n"), F.lit("\n}\n")).alias("dot"))
