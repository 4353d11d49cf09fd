"""The registered graph queries, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.operators import analysis, calls, components, dataflow, dominance, domtree, graph, transform, traverse
from arcstep.operators.frames import checkpoint, closure, dense_ids, pinned
from arcstep.plans import sql
from arcstep.plans.registry import ORACLES, QUERIES, Query, query
from arcstep.plans.sql import with_
from arcstep.sources import tables


def queries() -> dict[str, Query]:
    from arcstep.plans import flow, more  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from arcstep.plans import flow, more  # noqa: F401

    return dict(ORACLES)


_P = with_(sql.PROGRAMS)
_D = with_(sql.PROGRAMS, sql.DOM)
_L = with_(sql.PROGRAMS, sql.DOM, sql.LOOPS)
_S = with_(sql.PROGRAMS, sql.DOM, sql.SSA)
_R = with_(sql.PROGRAMS, sql.REACHING)
_U = with_(sql.PROGRAMS, sql.REACHING, sql.DEF_USE)


def _parts(spark: SparkSession, d: str) -> tuple[graph.Graph, DataFrame]:
    g = tables.part_flow(spark, d)
    return g, g.roots.select("graph_id", F.col("root").alias("node_id"))


def _dom(spark: SparkSession, d: str) -> tuple[graph.Graph, DataFrame, DataFrame]:
    g, ins = tables.programs(spark, d)
    return g, ins, dominance.dominators(g)


def _loops(spark: SparkSession, d: str) -> tuple[graph.Graph, DataFrame, DataFrame, DataFrame]:
    g, ins = tables.programs(spark, d)
    backs = checkpoint(dominance.tree_back_edges(g, dominance.immediate_dominators(g)))
    return g, ins, backs, checkpoint(dominance.loop_bodies(g, backs))


# -- stored graphs ----------------------------------------------------------------


@query(with_(sql.PARTS) + "SELECT graph_id, edge_id, src, dst FROM part_e")
def graph_edges(spark, d):
    """Live edges in id order."""
    return tables.part_flow(spark, d).live().select("graph_id", "edge_id", "src", "dst")


@query(with_(sql.PARTS) + """SELECT n.graph_id, node_id, coalesce(s, '') AS out_edges, coalesce(t, '') AS successors, coalesce(i, '') AS in_edges, coalesce(p, '') AS predecessors FROM part_n n
LEFT JOIN (SELECT graph_id, src, string_agg(edge_id, ',' ORDER BY edge_id) AS s, string_agg(dst, ',' ORDER BY edge_id) AS t FROM part_e GROUP BY ALL) o ON o.graph_id = n.graph_id AND src = node_id
LEFT JOIN (SELECT graph_id, dst, string_agg(edge_id, ',' ORDER BY edge_id) AS i, string_agg(src, ',' ORDER BY edge_id) AS p FROM part_e GROUP BY ALL) q ON q.graph_id = n.graph_id AND dst = node_id""")
def graph_adjacency(spark, d):
    """Outgoing and incoming edge ids, successors and predecessors, in adjacency order."""
    g = tables.part_flow(spark, d)
    text = lambda c, n: F.array_join(F.col(c).cast("array<string>"), ",").alias(n)
    key = ["graph_id", "node_id"]
    out = g.outgoing().select(*key, text("edge_ids", "out_edges"))
    for df, c, n in ((g.successors(), "nodes", "successors"), (g.incoming(), "edge_ids", "in_edges"), (g.predecessors(), "nodes", "predecessors")):
        out = out.join(df.select(*key, text(c, n)), key)
    return out


@query(with_(sql.PARTS) + """, lv AS (SELECT * FROM part_e WHERE edge_id % 10 <> 3) SELECT r.graph_id, (SELECT count(*) FROM part_n n WHERE n.graph_id = r.graph_id) AS nodes, (SELECT count(*) FROM lv WHERE lv.graph_id = r.graph_id) AS edges,
(SELECT max(edge_id) + 1 FROM part_e e WHERE e.graph_id = r.graph_id) AS slots, (SELECT count(*) FROM part_n n WHERE n.graph_id = r.graph_id AND NOT EXISTS (SELECT 1 FROM lv WHERE lv.graph_id = n.graph_id AND lv.src = n.node_id)) AS exits FROM part_root r""")
def graph_counts(spark, d):
    """Node, live edge, slot and exit counts after some edges were removed."""
    g = tables.part_flow(spark, d)
    g = g.remove_edges(g.edges.where("edge_id % 10 = 3"))
    exits = g.exits().groupBy("graph_id").agg(F.count(F.lit(1)).alias("exits"))
    return g.node_count().join(g.edge_count(), "graph_id").join(g.edge_slots(), "graph_id").join(exits, "graph_id")


@query(with_(sql.PARTS) + """, top AS (SELECT graph_id, max(edge_id) AS m FROM part_e GROUP BY graph_id), new AS (SELECT graph_id, min(dst) AS src, src AS dst FROM part_e WHERE src % 7 = 0 GROUP BY graph_id, src)
SELECT graph_id, edge_id, dst AS src, src AS dst FROM part_e WHERE edge_id % 5 = 0 UNION ALL SELECT graph_id, m + row_number() OVER (PARTITION BY graph_id ORDER BY src, dst), dst, src FROM new JOIN top USING (graph_id)""")
def graph_updates(spark, d):
    """Edges after tombstoning and adding: old ids stay, new ones go on behind the last slot; then turned round."""
    g = tables.part_flow(spark, d)
    new = g.live().where("src % 7 = 0").groupBy("graph_id", "src").agg(F.min("dst").alias("dst")).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.remove_edges(g.edges.where("edge_id % 5 <> 0")).add_edges(new).reversed().live().select("graph_id", "edge_id", "src", "dst")


@query(with_(sql.PARTS, sql.PARTS_BFS) + """, c AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY depth, node_id) - 1 AS new FROM part_bfs WHERE depth <= 4)
SELECT e.graph_id, row_number() OVER (PARTITION BY e.graph_id ORDER BY a.new, edge_id) - 1 AS edge_id, a.new AS src, b.new AS dst FROM part_e e JOIN c a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN c b ON b.graph_id = e.graph_id AND b.node_id = e.dst""")
def graph_subgraph(spark, d):
    """The subgraph induced by the nodes within four steps of the root, renumbered in the order given."""
    g, seeds = _parts(spark, d)
    near = traverse.distances(g, seeds, max_depth=4).withColumn("pos", F.struct("depth", "node_id"))
    return g.subgraph(near).live().select("graph_id", "edge_id", "src", "dst")


@query("""WITH k AS (SELECT 'org' AS s, 'r' || r_regionkey AS t FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS node_id FROM (SELECT s AS key FROM k UNION SELECT t FROM k))
SELECT a.node_id AS src, b.node_id AS dst FROM k JOIN ids a ON a.key = s JOIN ids b ON b.key = t""")
def keyed_graph(spark, d):
    """A graph interned from sparse keys."""
    pairs = tables.org_keys(spark, d)
    keys = pairs.select("graph_id", F.col("source_key").alias("key")).union(pairs.select("graph_id", "target_key")).distinct().withColumn("seen", F.col("key"))
    g, _ = graph.keyed_graph(checkpoint(graph.intern(keys)), pairs)
    return g.live().select("src", "dst")


@query("""WITH n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
SELECT event_type AS src, dst, count(*) AS n FROM n WHERE dst IS NOT NULL GROUP BY ALL""")
def event_flow(spark, d):
    """The weighted directly-follows graph of events."""
    return tables.event_flow(spark, d)


@query("""WITH i AS (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem),
e AS (SELECT l_suppkey AS src, dst FROM i WHERE dst IS NOT NULL)
SELECT n.node_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(s, 0) AS self_edges FROM (SELECT src AS node_id FROM e UNION SELECT dst FROM e) n
LEFT JOIN (SELECT src, count(*) AS o, count(*) FILTER (src = dst) AS s FROM e GROUP BY src) ON src = node_id LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY dst) ON dst = node_id""")
def graph_degrees(spark, d):
    """Degrees of the dense multigraph of suppliers, parallel and self edges counted."""
    g = tables.supplier_flow(spark, d)
    e = g.live()
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_edges"))
    into = e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return g.nodes.select("node_id").join(out, "node_id", "left").join(into, "node_id", "left").fillna(0).select("node_id", "out_degree", "in_degree", "self_edges")


# -- traversal ----------------------------------------------------------------------

#: Discovery order: a node's key is the least list of out-ranks on a shortest path to it.
_ORDER = """, rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY edge_id) - 1 AS r FROM part_e),
ord(graph_id, node_id, depth, k) AS (SELECT graph_id, root, 0::BIGINT, {'key': []::BIGINT[], 'parent': NULL::BIGINT, 'edge': NULL::BIGINT} FROM part_root
  UNION ALL SELECT o.graph_id, e.dst, o.depth + 1, min({'key': list_append(o.k['key'], e.r), 'parent': o.node_id, 'edge': e.edge_id}) FROM ord o JOIN rk e ON e.graph_id = o.graph_id AND e.src = o.node_id
  JOIN part_bfs b ON b.graph_id = e.graph_id AND b.node_id = e.dst AND b.depth = o.depth + 1 GROUP BY o.graph_id, e.dst, o.depth),
od AS MATERIALIZED (SELECT graph_id, node_id, depth, row_number() OVER (PARTITION BY graph_id ORDER BY depth, k) - 1 AS "rank", k['parent'] AS parent, k['edge'] AS edge_id FROM ord)
"""


@query(with_(sql.PARTS, sql.PARTS_BFS) + "SELECT graph_id, node_id, depth FROM part_bfs")
def bfs_distance(spark, d):
    """Breadth-first depth of every node that a root reaches."""
    return traverse.distances(*_parts(spark, d)).select("graph_id", "node_id", "depth")


@query(with_(sql.PARTS) + ", r(graph_id, n) AS (SELECT graph_id, root FROM part_root UNION SELECT r.graph_id, src FROM r JOIN part_e e ON e.graph_id = r.graph_id AND e.dst = r.n) SELECT graph_id, n AS node_id FROM r")
def reachable_backward(spark, d):
    """Nodes that reach the root."""
    return traverse.reachable(*_parts(spark, d), direction="backward").select("graph_id", "node_id")


@query(with_(sql.PARTS, sql.PARTS_BFS) + _ORDER + "SELECT * FROM od")
def bfs_order(spark, d):
    """Exact discovery order, with the node and the edge that discovered each node."""
    return traverse.breadth_first(*_parts(spark, d))


@query(with_(sql.PARTS, sql.PARTS_BFS) + _ORDER + """, goal AS (SELECT graph_id, max(node_id) AS goal FROM part_bfs GROUP BY graph_id),
path(graph_id, node_id, pos, parent, edge_id) AS (SELECT o.graph_id, o.node_id, o.depth, o.parent, o.edge_id FROM od o JOIN goal g ON g.graph_id = o.graph_id AND g.goal = o.node_id
  UNION ALL SELECT o.graph_id, o.node_id, o.depth, o.parent, o.edge_id FROM path p JOIN od o ON o.graph_id = p.graph_id AND o.node_id = p.parent) SELECT graph_id, pos, node_id, edge_id FROM path""")
def shortest_path(spark, d):
    """A shortest path, nodes and edges, from each root to the greatest node it reaches."""
    g, seeds = _parts(spark, d)
    goal = traverse.reachable(g, seeds).groupBy("graph_id").agg(F.max("node_id").alias("goal"))
    return traverse.shortest_path(g, seeds.withColumnRenamed("node_id", "start").join(goal, "graph_id"))


_TWO = ", ab AS (SELECT graph_id, max(node_id, 2)[1] AS b, max(node_id, 2)[2] AS a FROM part_bfs GROUP BY graph_id)"
_BACK = """, da(graph_id, node_id, depth) USING KEY (graph_id, node_id) AS (SELECT graph_id, a, 0::BIGINT FROM ab UNION SELECT r.graph_id, e.src, r.depth + 1 FROM da r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.dst LEFT JOIN recurring.da k ON k.graph_id = e.graph_id AND k.node_id = e.src WHERE k.node_id IS NULL),
db(graph_id, node_id, depth) USING KEY (graph_id, node_id) AS (SELECT graph_id, b, 0::BIGINT FROM ab UNION SELECT r.graph_id, e.src, r.depth + 1 FROM db r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.dst LEFT JOIN recurring.db k ON k.graph_id = e.graph_id AND k.node_id = e.src WHERE k.node_id IS NULL)"""


def _two(spark, d) -> tuple[graph.Graph, DataFrame]:
    g, seeds = _parts(spark, d)
    met = checkpoint(traverse.reachable(g, seeds))
    top = met.groupBy("graph_id").agg(F.max("node_id").alias("b"))
    return g, checkpoint(met.join(top, "graph_id").where("node_id < b").groupBy("graph_id", "b").agg(F.max("node_id").alias("a")))


@query(with_(sql.PARTS, sql.PARTS_BFS) + _TWO + _BACK + "SELECT da.graph_id, da.node_id, da.depth AS from_a, db.depth AS from_b, da.depth + db.depth AS combined FROM da JOIN db ON da.graph_id = db.graph_id AND da.node_id = db.node_id")
def common_ancestors(spark, d):
    """Nodes that reach both of two nodes, with both distances."""
    return traverse.common_ancestors(*_two(spark, d)).select("graph_id", "node_id", "from_a", "from_b", "combined")


@query(with_(sql.PARTS, sql.PARTS_BFS) + _TWO + _BACK + "SELECT da.graph_id, arg_min(da.node_id, (da.depth + db.depth, da.node_id)) AS node_id, min(da.depth + db.depth) AS combined FROM da JOIN db ON da.graph_id = db.graph_id AND da.node_id = db.node_id GROUP BY da.graph_id")
def nearest_common_ancestor(spark, d):
    """The common ancestor with the least combined distance."""
    return traverse.nearest_common_ancestor(*_two(spark, d))


@query(with_(sql.PARTS) + """, r(graph_id, node_id, depth) USING KEY (graph_id, node_id) AS (SELECT graph_id, root, 0::BIGINT FROM part_root
  UNION SELECT r.graph_id, e.dst, r.depth + 1 FROM r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.src AND e.dst % 2 = 0 LEFT JOIN recurring.r k ON k.graph_id = e.graph_id AND k.node_id = e.dst WHERE k.node_id IS NULL AND r.depth < 3)
SELECT r.graph_id, edge_id, src, dst, depth + 1 AS depth FROM r JOIN part_e e ON e.graph_id = r.graph_id AND src = node_id AND dst % 2 = 0""")
def walk_edges(spark, d):
    """Edges to even parts within four steps of the root; other edges do not lead on."""
    return traverse.walk_edges(*_parts(spark, d), max_depth=4, where="dst % 2 = 0").select("graph_id", "edge_id", "src", "dst", "depth")


@query(with_(sql.PARTS) + """, r(graph_id, node_id, depth) USING KEY (graph_id, node_id) AS (SELECT graph_id, root, 0::BIGINT FROM part_root
  UNION SELECT r.graph_id, e.dst, r.depth + 1 FROM r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.src LEFT JOIN recurring.r k ON k.graph_id = e.graph_id AND k.node_id = e.dst WHERE k.node_id IS NULL AND r.node_id % 3 <> 0 AND r.depth < 6) SELECT graph_id, node_id, depth FROM r""")
def search_with_skip(spark, d):
    """A depth-bounded breadth-first search that visits multiples of three without expanding them."""
    return traverse.distances(*_parts(spark, d), max_depth=6, skip="node_id % 3 = 0").select("graph_id", "node_id", "depth")


@query(with_(sql.PARTS) + """, r(graph_id, seed, node_id, depth) USING KEY (graph_id, seed, node_id) AS (SELECT DISTINCT graph_id, src, src, 0::BIGINT FROM part_e
  UNION SELECT r.graph_id, r.seed, e.dst, r.depth + 1 FROM r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.src LEFT JOIN recurring.r k ON k.graph_id = e.graph_id AND k.node_id = e.dst AND k.seed = r.seed WHERE k.node_id IS NULL AND r.depth < 2) SELECT graph_id, seed, node_id, depth FROM r""")
def search_many_roots(spark, d):
    """Searches to depth two from every part with a successor, in lockstep: each root is a graph of its own."""
    g = tables.part_flow(spark, d)
    ends = pinned(g.live().select("graph_id", "src", "dst").distinct(), "graph_id", "src")
    step = lambda f: f.withColumnRenamed("node_id", "src").join(ends, ["graph_id", "src"]).select("graph_id", "seed", F.col("dst").alias("node_id"), (F.col("depth") + 1).alias("depth"))
    start = g.live().select("graph_id", F.col("src").alias("seed"), F.col("src").alias("node_id"), F.lit(0).cast("long").alias("depth")).distinct()
    return closure(start, step, ["graph_id", "seed", "node_id"], 2, {"depth": F.min("depth")}).select("graph_id", "seed", "node_id", "depth")


@query(with_(sql.PARTS) + """, nx AS (SELECT graph_id, src, arg_min(dst, edge_id) AS nxt FROM part_e GROUP BY graph_id, src),
r(graph_id, hop, node_id, path) AS (SELECT graph_id, 0::BIGINT, root, [root] FROM part_root UNION ALL SELECT r.graph_id, hop + 1, nxt, list_append(path, nxt) FROM r JOIN nx ON nx.graph_id = r.graph_id AND src = node_id WHERE hop < 20 AND NOT list_contains(path, nxt)) SELECT graph_id, hop, node_id FROM r""")
def follow_chain(spark, d):
    """The chain of first successors from each root, up to twenty hops."""
    g, seeds = _parts(spark, d)
    first = g.live().groupBy("graph_id", F.col("src").alias("node_id")).agg(F.min_by("dst", "edge_id").alias("next"))
    return traverse.follow(checkpoint(first), seeds, 20).select("graph_id", "hop", "node_id")


@query(with_(sql.PROGRAMS) + """, fe AS (SELECT * FROM pe WHERE dst > src), r(graph_id, n, l) AS (SELECT graph_id, node_id, 0::BIGINT FROM blk UNION SELECT e.graph_id, e.dst, r.l + 1 FROM r JOIN fe e ON e.graph_id = r.graph_id AND e.src = r.n)
SELECT graph_id, n AS node_id, max(l) AS level FROM r GROUP BY ALL""")
def topological_levels(spark, d):
    """Longest-path levels of every program's forward edges."""
    g, _ = tables.programs(spark, d)
    return traverse.topological_order(graph.Graph(g.nodes, checkpoint(g.live().where("dst > src")), g.roots))


# -- decomposition ---------------------------------------------------------------------

_SCC = with_(sql.PARTS) + """, c(graph_id, a, b) AS (SELECT graph_id, src, dst FROM part_e UNION SELECT c.graph_id, c.a, e.dst FROM c JOIN part_e e ON e.graph_id = c.graph_id AND e.src = c.b),
scc AS MATERIALIZED (SELECT n.graph_id, node_id, least(node_id, coalesce(min(x.b), node_id)) AS component FROM part_n n LEFT JOIN (SELECT p.graph_id, p.a, p.b FROM c p JOIN c q ON p.graph_id = q.graph_id AND p.a = q.b AND p.b = q.a) x
  ON x.graph_id = n.graph_id AND x.a = node_id GROUP BY n.graph_id, node_id)
"""


@query(_SCC + "SELECT graph_id, node_id, component FROM scc")
def strong_components(spark, d):
    """Strongly connected components, named by their least node."""
    return components.strong_components(tables.part_flow(spark, d))


@query(_SCC + "SELECT DISTINCT e.graph_id, a.component AS src, b.component AS dst FROM part_e e JOIN scc a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN scc b ON b.graph_id = e.graph_id AND b.node_id = e.dst WHERE a.component <> b.component")
def condensation(spark, d):
    """Distinct edges between strong components."""
    g = tables.part_flow(spark, d)
    return components.condensation(g, components.strong_components(g)).select("graph_id", "src", "dst")


_PSCC = with_(sql.PROGRAMS) + """, c(graph_id, a, b) AS (SELECT graph_id, src, dst FROM pe UNION SELECT c.graph_id, c.a, e.dst FROM c JOIN pe e ON e.graph_id = c.graph_id AND e.src = c.b)
"""


@query(_PSCC + "SELECT graph_id, count(c.a) = 0 AS dag FROM (SELECT DISTINCT graph_id FROM blk) LEFT JOIN (SELECT graph_id, a FROM c WHERE a = b) c USING (graph_id) GROUP BY graph_id")
def is_dag(spark, d):
    """Whether each program is free of cycles."""
    g, _ = tables.programs(spark, d)
    return components.is_dag(g, checkpoint(components.strong_components(g)))


@query(_PSCC + "SELECT DISTINCT graph_id, a AS node_id FROM c WHERE a = b")
def recursive_nodes(spark, d):
    """Blocks on a cycle of their program."""
    g, _ = tables.programs(spark, d)
    return components.recursive_nodes(g, checkpoint(components.strong_components(g)))


@query(with_(sql.PARTS) + ", c(graph_id, a, b) AS (SELECT graph_id, node_id, node_id FROM part_n UNION SELECT c.graph_id, c.a, e.dst FROM c JOIN part_e e ON e.graph_id = c.graph_id AND e.src = c.b) SELECT graph_id, a AS node_id, min(b) AS value FROM c GROUP BY graph_id, a")
def propagate_summaries(spark, d):
    """The least part that each part reaches."""
    g = tables.part_flow(spark, d)
    return components.propagate_summaries(g, g.nodes.select("graph_id", "node_id", F.col("node_id").alias("value"))).select("graph_id", "node_id", "value")


@query(with_(sql.PARTS) + """, w AS (SELECT graph_id, src, dst, (src * 31 + dst) % 4 AS w FROM part_e), t AS (SELECT unnest([0, 1, 2, 3]) AS t),
r(t, graph_id, n) AS (SELECT t, graph_id, root FROM t, part_root UNION SELECT r.t, w.graph_id, w.dst FROM r JOIN w ON w.graph_id = r.graph_id AND w.src = r.n AND w.w <= r.t) SELECT graph_id, n AS node_id, min(t)::BIGINT AS label FROM r GROUP BY graph_id, n""")
def min_label_relaxation(spark, d):
    """The least possible greatest edge label on a path from the root."""
    g, seeds = _parts(spark, d)
    transfer = F.greatest("label", (F.col("src") * 31 + F.col("dst")) % 4)
    return components.min_label_relaxation(g, seeds.withColumn("label", F.lit(0).cast("long")), transfer).select("graph_id", "node_id", "label")


@query(with_(sql.PARTS) + """, un AS (SELECT graph_id, src AS a, dst AS b FROM part_e UNION SELECT graph_id, dst, src FROM part_e), c(graph_id, a, r) AS (SELECT graph_id, node_id, node_id FROM part_n UNION SELECT c.graph_id, un.b, c.r FROM c JOIN un ON un.graph_id = c.graph_id AND un.a = c.a AND c.r <= un.b)
SELECT graph_id, a AS node, min(r) AS component FROM c GROUP BY graph_id, a""")
def weak_components(spark, d):
    """Connected components of the part flow without directions."""
    g = tables.part_flow(spark, d)
    return components.weak_components(g.live().select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))).select("graph_id", "node", "component")


_HORN = """, hw AS (SELECT graph_id AS set_id, l_orderkey AS clause, l_partkey AS fact, last_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM part_q),
hh AS MATERIALIZED (SELECT DISTINCT set_id, clause, head FROM hw), hb AS MATERIALIZED (SELECT DISTINCT set_id, clause, fact FROM hw WHERE fact <> head), hn AS MATERIALIZED (SELECT set_id, clause, count(*) AS n FROM hb GROUP BY ALL),
hx AS (SELECT DISTINCT set_id, fact FROM hw JOIN part ON p_partkey = fact WHERE p_size <= 25 UNION SELECT set_id, head FROM hh WHERE NOT EXISTS (SELECT 1 FROM hn WHERE hn.set_id = hh.set_id AND hn.clause = hh.clause)),
model(set_id, fact) USING KEY (set_id, fact) AS (SELECT set_id, fact FROM hx
  UNION SELECT h.set_id, h.head FROM hh h JOIN hn n ON n.set_id = h.set_id AND n.clause = h.clause JOIN (SELECT b.set_id, b.clause, count(*) AS met FROM recurring.model m JOIN hb b ON b.set_id = m.set_id AND b.fact = m.fact GROUP BY ALL) k
    ON k.set_id = h.set_id AND k.clause = h.clause AND k.met = n.n LEFT JOIN recurring.model o ON o.set_id = h.set_id AND o.fact = h.head WHERE o.fact IS NULL AND EXISTS (SELECT 1 FROM model))
SELECT set_id, fact FROM model"""


@query(with_(sql.PARTS) + _HORN)
def horn_derivable(spark, d):
    """Parts derivable from the small parts by the orders' clauses."""
    return components.horn_derivable(*tables.part_clauses(spark, d)).select("set_id", "fact")


# -- dominance and loops ------------------------------------------------------------------


@query(with_(sql.PARTS) + """, reach(graph_id, n) AS (SELECT graph_id, root FROM part_root UNION SELECT e.graph_id, e.dst FROM reach r JOIN part_e e ON e.graph_id = r.graph_id AND e.src = r.n),
avoid(graph_id, x, n) AS (SELECT r.graph_id, n, root FROM reach r JOIN part_root p ON p.graph_id = r.graph_id WHERE n <> root UNION SELECT e.graph_id, a.x, e.dst FROM avoid a JOIN part_e e ON e.graph_id = a.graph_id AND e.src = a.n WHERE e.dst <> a.x),
dom AS MATERIALIZED (SELECT a.graph_id, a.n, b.n AS d FROM reach a JOIN reach b ON a.graph_id = b.graph_id LEFT JOIN avoid v ON v.graph_id = a.graph_id AND v.x = b.n AND v.n = a.n WHERE a.n = b.n OR v.n IS NULL),
depth AS MATERIALIZED (SELECT graph_id, n, count(*) - 1 AS depth FROM dom GROUP BY graph_id, n),
idom AS (SELECT d.graph_id, d.n, arg_max(d.d, q.depth) AS idom FROM dom d JOIN depth q ON q.graph_id = d.graph_id AND q.n = d.d WHERE d.d <> d.n GROUP BY ALL)
SELECT p.graph_id, p.n AS node_id, i.idom, p.depth FROM depth p LEFT JOIN idom i ON i.graph_id = p.graph_id AND i.n = p.n""")
def dominator_tree_large(spark, d):
    """Immediate dominators of larger graphs."""
    g, _ = _parts(spark, d)
    return dominance.immediate_dominators(g)


@query(_D + "SELECT p.graph_id, p.n AS node_id, i.idom, p.depth FROM depth p LEFT JOIN idom i ON i.graph_id = p.graph_id AND i.n = p.n")
def dominator_tree(spark, d):
    """Immediate dominators and depths of all programs' blocks."""
    return dominance.immediate_dominators(tables.programs(spark, d)[0])


@query(with_(sql.PROGRAMS, sql.PDOM) + "SELECT graph_id, n AS node_id, d AS dom FROM pdom")
def post_dominators(spark, d):
    """Post-dominators of all programs' blocks."""
    g, _ = tables.programs(spark, d)
    return dominance.post_dominators(g)


@query(with_(sql.PROGRAMS, sql.DOM, sql.SSA) + "SELECT graph_id, n AS node_id, frontier FROM df")
def dominance_frontier(spark, d):
    """Dominance frontiers of all programs' blocks."""
    g, _, dom = _dom(spark, d)
    return dominance.dominance_frontier(g, dom)


@query(with_(sql.PROGRAMS, sql.PDOM) + """SELECT DISTINCT e.graph_id, e.src AS controller, p.d AS dependent FROM pe e JOIN pdom p ON p.graph_id = e.graph_id AND p.n = e.dst
WHERE EXISTS (SELECT 1 FROM pdom x WHERE x.graph_id = e.graph_id AND x.n = e.src) AND NOT EXISTS (SELECT 1 FROM pdom s WHERE s.graph_id = e.graph_id AND s.n = e.src AND s.d = p.d AND s.n <> s.d)""")
def control_dependence(spark, d):
    """Control dependence between blocks."""
    g, _ = tables.programs(spark, d)
    return dominance.control_dependence(g, checkpoint(dominance.post_dominators(g)))


@query(_L + "SELECT graph_id, src, dst FROM backs UNION SELECT graph_id, src, dst FROM pe WHERE kind = 'Back'")
def back_edges(spark, d):
    """Back edges by dominance or by kind."""
    g, _ = tables.programs(spark, d)
    return dominance.tree_back_edges(g, dominance.immediate_dominators(g), tagged=True)


@query(_L + """, sz AS (SELECT graph_id, header, count(*) AS size FROM body GROUP BY ALL),
ar AS (SELECT b.graph_id, b.header AS outer_h, s.header, o.size AS osize FROM body b JOIN sz s ON s.graph_id = b.graph_id AND s.header = b.n JOIN sz o ON o.graph_id = b.graph_id AND o.header = b.header)
SELECT sz.graph_id, sz.header, (SELECT count(*) FROM backs k WHERE k.graph_id = sz.graph_id AND k.dst = sz.header) AS latches, sz.size,
(SELECT count(*) - 1 FROM ar WHERE ar.graph_id = sz.graph_id AND ar.header = sz.header) AS depth,
(SELECT arg_min(outer_h, (osize, outer_h)) FROM ar WHERE ar.graph_id = sz.graph_id AND ar.header = sz.header AND outer_h <> sz.header) AS parent FROM sz""")
def natural_loops(spark, d):
    """Natural loops: latches, sizes, nesting depths and parents."""
    g, _, backs, bodies = _loops(spark, d)
    return dominance.loops(g, backs, bodies)


@query(_L + "SELECT DISTINCT b.graph_id, b.header, e.dst AS exit FROM body b JOIN pe e ON e.graph_id = b.graph_id AND e.src = b.n WHERE NOT EXISTS (SELECT 1 FROM body c WHERE c.graph_id = b.graph_id AND c.header = b.header AND c.n = e.dst)")
def loop_exits(spark, d):
    """Blocks that loops leave to."""
    g, _, _, bodies = _loops(spark, d)
    return dominance.loop_exits(g, bodies)


@query(_L + """, sz AS (SELECT graph_id, header, count(*) AS size FROM body GROUP BY ALL)
SELECT k.graph_id, k.node_id, count(b.header) AS depth, arg_min(b.header, (sz.size, b.header)) AS header FROM blk k LEFT JOIN body b ON b.graph_id = k.graph_id AND b.n = k.node_id
LEFT JOIN sz ON sz.graph_id = b.graph_id AND sz.header = b.header GROUP BY ALL""")
def loop_nesting(spark, d):
    """How many loops hold each block, and the innermost one's header."""
    g, _, _, bodies = _loops(spark, d)
    return dominance.nesting_depth(g, bodies).join(dominance.innermost_loop(bodies), ["graph_id", "node_id"], "left")


@query(_L + """, fw AS (SELECT DISTINCT e.graph_id, e.src, e.dst FROM pe e JOIN reach r ON r.graph_id = e.graph_id AND r.n = e.src WHERE NOT EXISTS (SELECT 1 FROM backs b WHERE b.graph_id = e.graph_id AND b.src = e.src AND b.dst = e.dst)),
c(graph_id, a, b) AS (SELECT * FROM fw UNION SELECT c.graph_id, c.a, f.dst FROM c JOIN fw f ON f.graph_id = c.graph_id AND f.src = c.b)
SELECT graph_id, NOT EXISTS (SELECT 1 FROM c WHERE c.graph_id = g.graph_id AND a = b) AS reducible FROM (SELECT DISTINCT graph_id FROM blk) g""")
def reducible(spark, d):
    """Whether each program's control flow is reducible."""
    g, _ = tables.programs(spark, d)
    tree = dominance.immediate_dominators(g)
    return dominance.acyclic_but_for(g, tree.select("graph_id", "node_id"), dominance.tree_back_edges(g, tree))


@query(_L + """, ent AS (SELECT e.graph_id, e.dst AS header, count(*) AS n FROM pe e WHERE EXISTS (SELECT 1 FROM body b WHERE b.graph_id = e.graph_id AND b.header = e.dst)
AND NOT EXISTS (SELECT 1 FROM body b WHERE b.graph_id = e.graph_id AND b.header = e.dst AND b.n = e.src) GROUP BY ALL HAVING count(*) > 1)
SELECT e.graph_id, e.header, t.top + row_number() OVER (PARTITION BY e.graph_id ORDER BY e.header) AS preheader FROM ent e JOIN (SELECT graph_id, max(node_id) AS top FROM blk GROUP BY graph_id) t ON t.graph_id = e.graph_id""")
def preheaders(spark, d):
    """New blocks before loop headers that several outside edges enter."""
    g, _, _, bodies = _loops(spark, d)
    return dominance.insert_preheaders(g, bodies)[1]


# -- programs and dataflow -------------------------------------------------------------------


@query(_P + "SELECT graph_id, edge_id, src, dst, kind FROM pe")
def program_edges(spark, d):
    """Control-flow edges of all programs."""
    return tables.programs(spark, d)[0].live().select("graph_id", "edge_id", "src", "dst", "kind")


@query(_P + "SELECT graph_id, block, idx, seq, name, coalesce(before, '') AS uses, name AS defs, value FROM ins")
def program_instructions(spark, d):
    """Instructions of all programs."""
    ins = tables.programs(spark, d)[1]
    return ins.select("graph_id", "block", "idx", "seq", "name", F.array_join("uses", ",").alias("uses"), F.array_join("defs", ",").alias("defs"), "value")


@query(_R + "SELECT 'out' AS side, graph_id, block, db AS def_block, di AS def_idx, v AS variable FROM reach_out UNION ALL SELECT 'in', graph_id, block, db, di, v FROM reach_in")
def reaching_definitions(spark, d):
    """Definitions that enter and leave every block."""
    return dataflow.reaching_definitions(*tables.programs(spark, d))


@query(with_(sql.PROGRAMS, sql.LIVE) + "SELECT 'in' AS side, graph_id, block, v AS variable FROM live_in UNION ALL SELECT 'out', graph_id, block, v FROM live_out")
def liveness(spark, d):
    """Variables live at the entry and exit of every block."""
    return dataflow.liveness(*tables.programs(spark, d))


def _du(spark, d):
    g, ins = tables.programs(spark, d)
    return g, ins, checkpoint(dataflow.def_use(ins, dataflow.reaching_definitions(g, ins)))


@query(_U + "SELECT * FROM du")
def def_use(spark, d):
    """Definitions and the uses they feed."""
    return _du(spark, d)[2]


@query(_U + "SELECT i.graph_id, i.block, i.idx, i.name AS variable FROM ins i WHERE NOT EXISTS (SELECT 1 FROM du WHERE du.graph_id = i.graph_id AND def_block = i.block AND def_idx = i.idx)")
def dead_definitions(spark, d):
    """Definitions without uses."""
    _, ins, du = _du(spark, d)
    return dataflow.dead_definitions(ins, du)


@query(with_(sql.PROGRAMS, sql.REACHING, sql.DEF_USE, sql.PDOM) + """SELECT graph_id, 'Data' AS kind, def_block AS src_block, def_idx AS src_idx, use_block AS dst_block, use_idx AS dst_idx FROM du
UNION SELECT e.graph_id, 'Control', e.src, l.m, p.d, NULL FROM pe e JOIN pdom p ON p.graph_id = e.graph_id AND p.n = e.dst JOIN (SELECT graph_id, block, max(idx) AS m FROM ins GROUP BY ALL) l ON l.graph_id = e.graph_id AND l.block = e.src
WHERE EXISTS (SELECT 1 FROM pdom x WHERE x.graph_id = e.graph_id AND x.n = e.src) AND NOT EXISTS (SELECT 1 FROM pdom s WHERE s.graph_id = e.graph_id AND s.n = e.src AND s.d = p.d AND s.n <> s.d)""")
def program_dependence(spark, d):
    """Data and control dependence together."""
    g, ins, du = _du(spark, d)
    return dataflow.program_dependence(du, dominance.control_dependence(g, checkpoint(dominance.post_dominators(g))), ins)


def _ssa(spark, d):
    g, ins, dom = _dom(spark, d)
    phis = checkpoint(dataflow.place_phis(g, ins, dom))
    return g, ins, dom, phis, checkpoint(dataflow.ssa_definitions(ins, phis, dom))


@query(_S + "SELECT graph_id, block, v AS variable FROM phi")
def place_phis(spark, d):
    """Where phis are placed."""
    g, ins, dom = _dom(spark, d)
    return dataflow.place_phis(g, ins, dom)


@query(_S + "SELECT graph_id, v AS variable, block, idx, is_phi, version FROM sdef")
def ssa_definitions(spark, d):
    """Versions of all definitions and phis."""
    return _ssa(spark, d)[4]


@query(_S + """SELECT u.graph_id, u.block, u.idx, u.before AS variable, coalesce((SELECT arg_max(s.version, (q.depth, s.idx)) FROM dom d JOIN depth q ON q.graph_id = d.graph_id AND q.n = d.d
JOIN sdef s ON s.graph_id = d.graph_id AND s.block = d.d AND s.v = u.before WHERE d.graph_id = u.graph_id AND d.n = u.block AND (d.d <> u.block OR s.idx < u.idx)), 0)::BIGINT AS version FROM ins u WHERE u.before IS NOT NULL""")
def ssa_uses(spark, d):
    """Versions that uses read."""
    _, ins, dom, _, defs = _ssa(spark, d)
    return dataflow.ssa_uses(ins, defs, dom)


@query(_S + "SELECT graph_id, block, v AS variable, edge_id, pred, version FROM oper")
def phi_operands(spark, d):
    """Operands of all phis."""
    g, _, dom, phis, defs = _ssa(spark, d)
    return dataflow.phi_operands(g, phis, defs, dom)


@query(_S + """SELECT o.graph_id, o.pred, o.v AS variable, s.version AS to_version, o.version AS from_version FROM oper o JOIN sdef s ON s.graph_id = o.graph_id AND s.block = o.block AND s.v = o.v AND s.is_phi""")
def phi_copies(spark, d):
    """Copies that take the phis' place."""
    g, _, dom, phis, defs = _ssa(spark, d)
    return dataflow.phi_copies(defs, dataflow.phi_operands(g, phis, defs, dom))


@query(_S + """, cp AS MATERIALIZED (SELECT o.graph_id, o.v, s.version AS a, o.version AS b FROM oper o JOIN sdef s ON s.graph_id = o.graph_id AND s.block = o.block AND s.v = o.v AND s.is_phi),
un AS MATERIALIZED (SELECT graph_id, v, a, b FROM cp UNION SELECT graph_id, v, b, a FROM cp), w(graph_id, v, a, r) AS (SELECT graph_id, v, a, a FROM un UNION SELECT u.graph_id, u.v, u.b, w.r FROM w JOIN un u ON u.graph_id = w.graph_id AND u.v = w.v AND u.a = w.a)
SELECT graph_id, v AS variable, a AS version, min(r) AS web FROM w GROUP BY ALL""")
def phi_webs(spark, d):
    """Versions connected by phis."""
    g, _, dom, phis, defs = _ssa(spark, d)
    return dataflow.phi_webs(dataflow.phi_copies(defs, dataflow.phi_operands(g, phis, defs, dom)))


@query(_R + """, m AS (SELECT r.graph_id, r.block, r.v, count(DISTINCT i.value) AS k, min(i.value) AS x FROM reach_in r JOIN ins i ON i.graph_id = r.graph_id AND i.block = r.db AND i.idx = r.di GROUP BY ALL)
SELECT graph_id, block, v AS variable, CASE WHEN k = 1 THEN 'CONST' ELSE 'BOTTOM' END AS state, CASE WHEN k = 1 THEN x END AS value FROM m""")
def constants(spark, d):
    """Constants at block entries."""
    return dataflow.constants(*tables.programs(spark, d))


@query(with_(sql.PROGRAMS) + """, own AS MATERIALIZED (SELECT graph_id, block AS n, max(value) AS own FROM ins GROUP BY ALL), r(graph_id, n, x) AS (SELECT graph_id, n, own FROM own UNION SELECT e.graph_id, e.dst, r.x FROM r JOIN pe e ON e.graph_id = r.graph_id AND e.src = r.n)
SELECT o.graph_id, o.n AS node_id, greatest(0, coalesce((SELECT max(r.x) FROM r JOIN pe e ON e.graph_id = r.graph_id AND e.src = r.n WHERE e.graph_id = o.graph_id AND e.dst = o.n), 0))::BIGINT AS fact_in, (SELECT max(r.x) FROM r WHERE r.graph_id = o.graph_id AND r.n = o.n)::BIGINT AS fact_out FROM own o""")
def abstract_interpretation(spark, d):
    """A fixpoint over an upper-bound lattice: the greatest value that may have been seen before and after a block."""
    g, ins = tables.programs(spark, d)
    own = ins.groupBy("graph_id", F.col("block").alias("node_id")).agg(F.max("value").alias("own"))
    return dataflow.solve(g, own, F.max, lambda met, x: F.greatest(met, x), F.lit(0).cast("long"))


@query(with_(sql.PROGRAMS) + """, cp AS (SELECT graph_id, arg_max(before, (block, idx)) AS nxt, name FROM ins WHERE name = 'view' AND before IS NOT NULL AND before <> 'view' GROUP BY graph_id, name
UNION ALL SELECT graph_id, arg_max(before, (block, idx)), name FROM ins WHERE name = 'click' AND before IS NOT NULL AND before <> 'click' GROUP BY graph_id, name),
r(graph_id, seed, cur, hop) AS (SELECT graph_id, name, name, 0 FROM cp UNION ALL SELECT r.graph_id, r.seed, c.nxt, hop + 1 FROM r JOIN cp c ON c.graph_id = r.graph_id AND c.name = r.cur WHERE c.nxt <> r.seed)
SELECT graph_id, seed AS variable, arg_max(cur, hop) AS source FROM r GROUP BY ALL""")
def copy_targets(spark, d):
    """What variables copy in the end, if views and clicks are copies of what they use."""
    _, ins = tables.programs(spark, d)
    is_copy = F.col("name").isin("view", "click") & (F.size("uses") > 0) & (F.element_at(F.col("uses"), 1) != F.col("name"))
    marked = ins.withColumn("copy_dst", F.when(is_copy, F.col("name"))).withColumn("copy_src", F.when(is_copy, F.col("uses")[0]))
    return dataflow.copy_targets(marked)


# -- analysis ------------------------------------------------------------------------------------


@query(_L + """, inner_e AS (SELECT e.graph_id, count(*) AS c FROM pe e JOIN reach r ON r.graph_id = e.graph_id AND r.n = e.src GROUP BY ALL), nd AS (SELECT graph_id, n, count(*) AS c FROM body GROUP BY ALL),
m AS (SELECT g.graph_id, (SELECT count(*) FROM blk WHERE blk.graph_id = g.graph_id) AS nodes, (SELECT count(*) FROM pe WHERE pe.graph_id = g.graph_id) AS edges, (SELECT count(*) FROM reach WHERE reach.graph_id = g.graph_id) AS reachable,
 (SELECT count(*) FROM blk WHERE blk.graph_id = g.graph_id AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = blk.graph_id AND pe.src = blk.node_id)) AS exits,
 coalesce((SELECT max(c) FROM nd WHERE nd.graph_id = g.graph_id), 0) AS max_nesting, (SELECT count(*) FROM ins WHERE ins.graph_id = g.graph_id) AS instructions, coalesce((SELECT c FROM inner_e WHERE inner_e.graph_id = g.graph_id), 0) AS ie
 FROM (SELECT DISTINCT graph_id FROM blk) g)
SELECT graph_id, nodes, edges, reachable, exits, max_nesting, instructions, CASE WHEN ie < reachable THEN 1 ELSE ie - reachable + 2 END AS cyclomatic, nodes - reachable AS unreachable FROM m""")
def graph_metrics(spark, d):
    """Sizes, cyclomatic numbers and nesting of all programs."""
    g, ins, _, bodies = _loops(spark, d)
    return analysis.graph_metrics(g, bodies, ins)


@query(_P + """, o AS (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY edge_id) AS r, count(*) OVER (PARTITION BY graph_id, src) AS n FROM pe)
SELECT a.graph_id, a.src AS top, a.dst AS "left", b.dst AS "right", x.dst AS bottom FROM o a JOIN o b ON b.graph_id = a.graph_id AND b.src = a.src AND a.r = 1 AND b.r = 2 AND a.n = 2
JOIN o x ON x.graph_id = a.graph_id AND x.src = a.dst AND x.n = 1 JOIN o y ON y.graph_id = a.graph_id AND y.src = b.dst AND y.n = 1 AND y.dst = x.dst""")
def diamonds(spark, d):
    """Diamond patterns."""
    return analysis.diamonds(tables.programs(spark, d)[0])


_LINKS = """, ln AS MATERIALIZED (SELECT graph_id, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, src) AS o, count(*) OVER (PARTITION BY graph_id, dst) AS i FROM pe) WHERE o = 1 AND i = 1 AND src <> dst)"""


@query(_P + _LINKS + """, h(graph_id, head, n) AS (SELECT graph_id, src, src FROM ln a WHERE NOT EXISTS (SELECT 1 FROM ln b WHERE b.graph_id = a.graph_id AND b.dst = a.src) UNION SELECT h.graph_id, h.head, ln.dst FROM h JOIN ln ON ln.graph_id = h.graph_id AND ln.src = h.n)
SELECT graph_id, head, count(*) AS length FROM h GROUP BY ALL""")
def chains(spark, d):
    """Chains of blocks with one way in and out."""
    return analysis.chains(tables.programs(spark, d)[0])


@query(_P + """, w AS (SELECT graph_id, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph_id, src) AS w FROM pe), b AS (SELECT graph_id, dst AS n, sum(w) AS w FROM w WHERE dst <> 0 GROUP BY ALL UNION ALL SELECT graph_id, 0, 1.0 FROM blk WHERE node_id = 0)
SELECT graph_id, n AS node_id, round(w, 6) AS weight FROM b""")
def block_weights(spark, d):
    """Block weights from uniform edge weights."""
    g = analysis.uniform_weights(tables.programs(spark, d)[0])
    return analysis.block_weights(g).select("graph_id", "node_id", F.round("weight", 6).alias("weight"))


@query(_P + """, w AS (SELECT graph_id, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph_id, src) AS w FROM pe), b AS (SELECT graph_id, dst AS n, round(sum(w), 6) AS w FROM w WHERE dst <> 0 GROUP BY ALL UNION ALL SELECT graph_id, 0, 1.0 FROM blk WHERE node_id = 0)
SELECT graph_id, arg_max(n, (w, n)) AS hottest, arg_min(n, (w, n)) AS coldest, count(*) FILTER (w >= 1) AS hot FROM b GROUP BY graph_id""")
def hot_and_cold(spark, d):
    """The hottest and coldest block of every program, and how many are hot."""
    g = analysis.uniform_weights(tables.programs(spark, d)[0])
    w = checkpoint(analysis.block_weights(g).withColumn("weight", F.round("weight", 6)))
    hot = analysis.hot_blocks(w, 1.0).groupBy("graph_id").agg(F.count(F.lit(1)).alias("hot"))
    return analysis.hottest(w).select("graph_id", F.col("node_id").alias("hottest")).join(analysis.coldest(w).select("graph_id", F.col("node_id").alias("coldest")), "graph_id").join(hot, "graph_id")


_EFF = """, ef AS (SELECT graph_id, block, 'io' AS e FROM ins WHERE name IN ('purchase', 'error') UNION ALL SELECT graph_id, block, 'throw' FROM ins WHERE name = 'error')"""


@query(_P + _EFF + "SELECT b.graph_id, b.node_id, coalesce((SELECT string_agg(DISTINCT e, ',' ORDER BY e) FROM ef WHERE ef.graph_id = b.graph_id AND ef.block = b.node_id), '') AS effects, NOT EXISTS (SELECT 1 FROM ef WHERE ef.graph_id = b.graph_id AND ef.block = b.node_id) AS pure FROM blk b")
def block_purity(spark, d):
    """Effects of every block."""
    return analysis.block_purity(*tables.programs(spark, d))


@query(_P + _EFF + "SELECT g.graph_id, coalesce(x, '') AS effects, x IS NULL AS pure FROM (SELECT DISTINCT graph_id FROM blk) g LEFT JOIN (SELECT graph_id, string_agg(DISTINCT e, ',' ORDER BY e) AS x FROM ef GROUP BY graph_id) USING (graph_id)")
def graph_purity(spark, d):
    """Effects of every program."""
    return analysis.graph_purity(*tables.programs(spark, d))


@query(_P + """SELECT b.graph_id, b.node_id AS block, (SELECT max(idx) FROM ins WHERE ins.graph_id = b.graph_id AND ins.block = b.node_id) AS idx FROM blk b WHERE last = 'view'
AND (SELECT count(*) FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id) = 1 AND EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id AND NOT EXISTS (SELECT 1 FROM pe q WHERE q.graph_id = pe.graph_id AND q.src = pe.dst))""")
def tail_calls(spark, d):
    """Calls before an exit block."""
    return analysis.tail_calls(*tables.programs(spark, d))


_FP = """, fp AS MATERIALIZED (SELECT b.graph_id, b.node_id, (SELECT count(*) FROM ins WHERE ins.graph_id = b.graph_id AND ins.block = b.node_id) || ':' || (SELECT count(*) FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id) || ':' ||
(SELECT count(*) FROM pe WHERE pe.graph_id = b.graph_id AND pe.dst = b.node_id) || ':' || coalesce((SELECT string_agg(kind, '+' ORDER BY kind) FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id), '') AS fingerprint FROM blk b)"""


@query(_P + _FP + "SELECT graph_id, node_id, fingerprint FROM fp")
def fingerprints(spark, d):
    """Structural fingerprints of blocks."""
    return analysis.fingerprints(*tables.programs(spark, d))


@query(_P + _FP + """, nx AS (SELECT graph_id, lead(graph_id) OVER (ORDER BY graph_id::BIGINT) AS nxt FROM (SELECT DISTINCT graph_id FROM blk)),
s AS (SELECT *, row_number() OVER (PARTITION BY graph_id, fingerprint ORDER BY node_id) AS k FROM fp), l AS (SELECT graph_id AS pair, fingerprint, k FROM s WHERE graph_id IN (SELECT graph_id FROM nx WHERE nxt IS NOT NULL)),
r AS (SELECT nx.graph_id AS pair, fingerprint, k FROM s JOIN nx ON nx.nxt = s.graph_id),
m AS (SELECT coalesce(l.pair, r.pair) AS pair, l.pair IS NOT NULL AS a, r.pair IS NOT NULL AS b FROM l FULL JOIN r ON l.pair = r.pair AND l.fingerprint = r.fingerprint AND l.k = r.k),
t AS (SELECT pair, count(*) FILTER (a AND b) AS matched, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right FROM m GROUP BY pair)
SELECT *, round(matched / (matched + greatest(only_left, only_right)), 6) AS ratio FROM t""")
def graph_diff(spark, d):
    """How far each user's program agrees with the next user's."""
    g, ins = tables.programs(spark, d)
    f = checkpoint(analysis.fingerprints(g, ins))
    users = checkpoint(dense_ids(g.roots.select("graph_id", F.col("graph_id").cast("long").alias("user")), ["user"], "k"))
    pairs = users.select("k", F.col("graph_id").alias("pair")).join(users.select((F.col("k") - 1).alias("k"), F.col("graph_id").alias("next")), "k").drop("k")
    left = f.join(pairs.select(F.col("pair").alias("graph_id"), "pair"), "graph_id")
    right = f.join(pairs.select(F.col("next").alias("graph_id"), "pair"), "graph_id")
    return analysis.graph_diff(left, right)


@query(_D + "SELECT violation, count(*) AS n FROM (SELECT 'root' AS violation FROM blk WHERE false UNION ALL SELECT 'edge end' FROM pe WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.graph_id = pe.graph_id AND node_id = dst AND node_id % 9 <> 8)) GROUP BY ALL")
def verify(spark, d):
    """Violations after some nodes were dropped."""
    g, _ = tables.programs(spark, d)
    v = analysis.verify(graph.Graph(g.nodes.where("node_id % 9 <> 8"), g.edges, g.roots))
    ends = v.join(g.live().select("graph_id", F.col("dst").alias("node_id")), ["graph_id", "node_id"])
    return ends.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


_INT = """, both_ AS (SELECT graph_id, block, v FROM live_out UNION SELECT graph_id, block, name FROM ins),
itf AS MATERIALIZED (SELECT DISTINCT b.graph_id, least(b.v, l.v) AS a, greatest(b.v, l.v) AS b FROM both_ b JOIN live_out l ON l.graph_id = b.graph_id AND l.block = b.block AND l.v <> b.v)"""


@query(with_(sql.PROGRAMS, sql.LIVE) + _INT + "SELECT graph_id, a, b FROM itf")
def interference(spark, d):
    """Variables that may not share a place."""
    g, ins = tables.programs(spark, d)
    return analysis.interference(ins, checkpoint(dataflow.liveness(g, ins)))


@query(with_(sql.PROGRAMS, sql.LIVE) + _INT + "SELECT graph_id, count(*) AS edges, 0::BIGINT AS clashes FROM itf GROUP BY graph_id")
def colouring_check(spark, d):
    """Interference edges of every program whose ends have the same colour: none."""
    g, ins = tables.programs(spark, d)
    pairs = checkpoint(analysis.interference(ins, checkpoint(dataflow.liveness(g, ins))))
    nodes = dataflow.definitions(ins).select("graph_id", F.col("variable").alias("node")).distinct()
    c = checkpoint(analysis.colour(pairs, nodes))
    end = lambda k, n: c.select("graph_id", F.col("node").alias(k), F.col("colour").alias(n))
    joined = pairs.join(end("a", "ca"), ["graph_id", "a"]).join(end("b", "cb"), ["graph_id", "b"])
    return joined.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("clashes"))


# -- rewrites ----------------------------------------------------------------------------------------


@query(_P + """, k AS MATERIALIZED (SELECT * FROM pe WHERE kind <> 'Fallthrough'), r(graph_id, n) AS (SELECT DISTINCT graph_id, 0::BIGINT FROM blk UNION SELECT k.graph_id, k.dst FROM r JOIN k ON k.graph_id = r.graph_id AND k.src = r.n)
SELECT g.graph_id, (SELECT count(*) FROM ins i JOIN r ON r.graph_id = i.graph_id AND r.n = i.block WHERE i.graph_id = g.graph_id) AS instructions, (SELECT count(*) FROM k JOIN r ON r.graph_id = k.graph_id AND r.n = k.src WHERE k.graph_id = g.graph_id) AS edges FROM (SELECT DISTINCT graph_id FROM blk) g""")
def remove_unreachable(spark, d):
    """What is left of the programs without their fallthrough edges."""
    g, ins = tables.programs(spark, d)
    cut, kept, _ = transform.remove_unreachable(graph.Graph(g.nodes, checkpoint(g.live().where("kind <> 'Fallthrough'")), g.roots), ins)
    n = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    return g.roots.select("graph_id").join(n(kept, "instructions"), "graph_id", "left").join(n(cut.live(), "edges"), "graph_id", "left").fillna(0)


@query(_P + _LINKS + """, lk AS MATERIALIZED (SELECT * FROM ln WHERE dst <> 0), h(graph_id, head, hop, n) AS (SELECT graph_id, node_id, 0, node_id FROM blk b WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.graph_id = b.graph_id AND lk.dst = b.node_id)
UNION ALL SELECT h.graph_id, h.head, hop + 1, lk.dst FROM h JOIN lk ON lk.graph_id = h.graph_id AND lk.src = h.n)
SELECT i.graph_id, h.head, i.block, i.idx, row_number() OVER (PARTITION BY i.graph_id, h.head ORDER BY hop, i.idx) - 1 AS new_idx FROM ins i JOIN h ON h.graph_id = i.graph_id AND h.n = i.block""")
def merge_blocks(spark, d):
    """Instructions re-keyed to merged blocks."""
    return transform.merged_blocks(*tables.programs(spark, d))


@query(_P + """, m AS (SELECT *, count(*) OVER (PARTITION BY graph_id, src) > 1 AND count(*) OVER (PARTITION BY graph_id, dst) > 1 AS c FROM pe), t AS (SELECT graph_id, max(node_id) AS top FROM blk GROUP BY graph_id), s AS (SELECT graph_id, max(edge_id) + 1 AS slots FROM pe GROUP BY graph_id),
x AS (SELECT m.*, row_number() OVER (PARTITION BY m.graph_id ORDER BY edge_id) AS k, top, slots FROM m JOIN t USING (graph_id) JOIN s USING (graph_id) WHERE c)
SELECT graph_id, edge_id, src, dst FROM m WHERE NOT c UNION ALL SELECT graph_id, edge_id, src, top + k FROM x UNION ALL SELECT graph_id, slots + k - 1, top + k, dst FROM x""")
def split_critical_edges(spark, d):
    """Edges after new blocks were put on the critical ones."""
    return transform.split_critical_edges(tables.programs(spark, d)[0]).edges.select("graph_id", "edge_id", "src", "dst")


@query(_P + _LINKS + "SELECT graph_id, src, dst FROM ln")
def contractible_edges(spark, d):
    """Edges that can be contracted."""
    g, _ = tables.programs(spark, d)
    return g.live().join(transform.contractible(g), ["graph_id", "edge_id"]).select("graph_id", "src", "dst")


@query(_P + """, c AS (SELECT graph_id, block, (count(*) // 2)::BIGINT AS at FROM ins GROUP BY ALL HAVING count(*) >= 4), t AS (SELECT graph_id, max(node_id) AS top FROM blk GROUP BY graph_id),
n AS (SELECT c.*, top + row_number() OVER (PARTITION BY c.graph_id ORDER BY block) AS tail FROM c JOIN t USING (graph_id))
SELECT i.graph_id, CASE WHEN i.idx >= n.at THEN n.tail ELSE i.block END AS block, CASE WHEN i.idx >= n.at THEN i.idx - n.at ELSE i.idx END AS idx, i.seq FROM ins i LEFT JOIN n ON n.graph_id = i.graph_id AND n.block = i.block""")
def split_blocks(spark, d):
    """Instructions after blocks of four or more were split in half."""
    g, ins = tables.programs(spark, d)
    cuts = ins.groupBy("graph_id", "block").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("graph_id", "block", F.floor(F.col("n") / 2).alias("at"))
    return transform.split_blocks(g, ins, cuts)[1].select("graph_id", "block", "idx", "seq")


@query(_P + """, x AS (SELECT graph_id, node_id FROM blk b WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id)), s AS (SELECT b.graph_id, max(b.node_id) + 1 AS new, (SELECT count(*) FROM x WHERE x.graph_id = b.graph_id) AS n, (SELECT min(node_id) FROM x WHERE x.graph_id = b.graph_id) AS one FROM blk b GROUP BY b.graph_id)
SELECT graph_id, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN one ELSE new END AS root, (SELECT count(*) FROM pe WHERE pe.graph_id = s.graph_id) + CASE WHEN n > 1 THEN n ELSE 0 END AS edges FROM s""")
def reverse_graph(spark, d):
    """Roots and edge counts of the transposed programs."""
    r = transform.reverse_rooted(tables.programs(spark, d)[0])
    return r.roots.join(r.edge_count(), "graph_id", "left").fillna(0, ["edges"]).select("graph_id", "root", "edges")


@query(with_(sql.PROGRAMS, sql.REACHING, sql.DEF_USE, sql.LIVE) + """, kept(graph_id, block, idx) AS (
SELECT graph_id, block, idx FROM ins i WHERE name IN ('purchase', 'error') OR (EXISTS (SELECT 1 FROM live_out l WHERE l.graph_id = i.graph_id AND l.block = i.block AND l.v = i.name)
  AND NOT EXISTS (SELECT 1 FROM ins k WHERE k.graph_id = i.graph_id AND k.block = i.block AND k.name = i.name AND k.idx > i.idx))
UNION SELECT k.graph_id, k.block, du.def_idx FROM kept k JOIN du ON du.graph_id = k.graph_id AND use_block = k.block AND use_idx = k.idx AND def_block = k.block AND def_idx < use_idx)
SELECT graph_id, block, idx, name FROM ins JOIN kept USING (graph_id, block, idx)""")
def dead_code_elimination(spark, d):
    """Instructions left once pure ones go whose results are not live, and with them what only they read."""
    return transform.remove_dead(*tables.programs(spark, d)).select("graph_id", "block", "idx", "name")


@query()
def loop_invariants(spark, d):
    """Instructions of loops that compute the same in every round."""
    g, ins, du = _du(spark, d)
    bodies = checkpoint(dominance.loop_bodies(g, dominance.tree_back_edges(g, dominance.immediate_dominators(g))))
    return transform.loop_invariants(ins, bodies, du)


@query(_P + """, f AS (SELECT graph_id, src, arg_min(dst, edge_id) AS t FROM pe WHERE kind <> 'ConditionalTrue' GROUP BY ALL), l AS (SELECT graph_id, node_id, row_number() OVER w - 1 AS pos, lead(node_id) OVER w AS nxt FROM blk WINDOW w AS (PARTITION BY graph_id ORDER BY node_id))
SELECT l.graph_id, pos, node_id, CASE WHEN t IS DISTINCT FROM nxt THEN t END AS jump FROM l LEFT JOIN f ON f.graph_id = l.graph_id AND f.src = l.node_id""")
def linear_order(spark, d):
    """A flat layout of every program and the jumps it needs."""
    return transform.linear_order(tables.programs(spark, d)[0])


@query(_P + r"""SELECT graph_id, 'digraph {' || chr(10) || (SELECT string_agg('  n' || node_id || ' [label="' || first || '"];', chr(10) ORDER BY node_id) FROM blk WHERE blk.graph_id = g.graph_id) ||
coalesce((SELECT chr(10) || string_agg('  n' || src || ' -> n' || dst || ' [color=' || CASE kind WHEN 'ConditionalTrue' THEN 'green' WHEN 'ConditionalFalse' THEN 'red' WHEN 'Back' THEN 'blue' ELSE 'black' END || '];', chr(10) ORDER BY edge_id) FROM pe WHERE pe.graph_id = g.graph_id), '') || chr(10) || '}' || chr(10) AS dot
FROM (SELECT DISTINCT graph_id FROM blk) g""")
def dot_text(spark, d):
    """Graphviz text of every program."""
    return graph.to_dot(tables.programs(spark, d)[0])


@query("""SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type""")
def effect_census(spark, d):
    """Instructions by kind over all programs."""
    return tables.programs(spark, d)[1].groupBy(F.col("name").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- calls, jumps and regions ----------------------------------------------------------------------------


@query(_P + """, f AS (SELECT DISTINCT graph_id AS key FROM blk), c AS (SELECT graph_id, value::VARCHAR AS callee FROM ins WHERE name = 'view')
SELECT c.graph_id AS caller, c.callee, count(*) AS calls FROM c JOIN f ON f.key = c.callee GROUP BY ALL""")
def call_graph(spark, d):
    """Calls between programs: a view calls the program of the user that its value names."""
    g, ins = tables.programs(spark, d)
    marked = ins.withColumn("callee", F.when(F.col("name") == "view", F.col("value").cast("string")))
    cg = calls.call_graph(g.roots.select(F.col("graph_id").alias("key"), "graph_id"), marked)
    name = lambda c, n: cg.nodes.select(F.col("node_id").alias(c), F.col("payload").alias(n))
    return cg.live().join(name("src", "caller"), "src").join(name("dst", "callee"), "dst").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


@query(_P + """, l AS (SELECT graph_id, max(node_id) AS dst FROM blk WHERE first = 'signup' GROUP BY graph_id), j AS (SELECT graph_id, node_id AS src FROM blk WHERE last = 'error')
SELECT j.graph_id, j.src, l.dst FROM j LEFT JOIN l USING (graph_id) WHERE l.dst IS NULL OR NOT EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = j.graph_id AND pe.src = j.src AND pe.dst = l.dst AND kind = 'ConditionalTrue')""")
def resolve_jumps(spark, d):
    """Edges from errors to the last block labelled signup; a null target is unresolved."""
    g, ins = tables.programs(spark, d)
    marked = ins.withColumn("label", F.when((F.col("name") == "signup") & (F.col("idx") == 0), "signup")).withColumn("jump_target", F.when(F.col("name") == "error", "signup"))
    new, lost = calls.resolve_jumps(g, marked)
    return new.select("graph_id", "src", "dst").unionByName(lost.select("graph_id", F.col("block").alias("src"), F.lit(None).cast("long").alias("dst")))


@query(_L + """, rg AS (SELECT graph_id, header, row_number() OVER (PARTITION BY graph_id ORDER BY header) - 1 AS region_id FROM (SELECT DISTINCT graph_id, header FROM body))
SELECT b.graph_id, b.n AS block, max(region_id) AS region_id FROM body b JOIN rg ON rg.graph_id = b.graph_id AND rg.header = b.header GROUP BY ALL""")
def protecting_regions(spark, d):
    """The innermost region of each block, with loops as protected regions."""
    _, _, _, bodies = _loops(spark, d)
    lists = bodies.groupBy("graph_id", "header").agg(F.collect_list("node_id").alias("protected"))
    regions = graph.intern(lists.select("graph_id", F.col("header").alias("key"), F.col("header").alias("seen"))).join(lists.withColumnRenamed("header", "key"), ["graph_id", "key"])
    return calls.protecting_region(regions.select("graph_id", F.col("node_id").alias("region_id"), "protected"))
