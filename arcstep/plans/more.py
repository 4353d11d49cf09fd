"""Further registered queries: built graphs, side tables, exceptions, aliases, rewrites, orders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from arcstep.operators import analysis, builder, calls, dataflow, depth_first, dominance, domtree, graph, transform, values
from arcstep.operators.frames import checkpoint
from arcstep.plans import sql
from arcstep.plans.registry import query
from arcstep.plans.sql import with_
from arcstep.sources import tables

_P = with_(sql.PROGRAMS)
_L = with_(sql.PROGRAMS, sql.DOM, sql.LOOPS)


# -- graphs built from streams ---------------------------------------------------------

_BUILT = with_(sql.STREAMS, sql.BUILT)
_FAULTY = with_(sql.FAULTY_STREAMS, sql.BUILT)


@query(_BUILT + "SELECT graph_id, edge_id, src, dst, kind FROM bedge")
def build_edges(spark, d):
    """Edges of the graphs built from all users' streams."""
    return builder.build(tables.streams(spark, d)).graph.live().select("graph_id", "edge_id", "src", "dst", "kind")


@query(_BUILT + "SELECT graph_id, seq, effect, block, row_number() OVER (PARTITION BY graph_id, block ORDER BY seq) - 1 AS idx FROM bst")
def build_instructions(spark, d):
    """Where the instructions of the streams stand in the graphs built."""
    return builder.build(tables.streams(spark, d)).instructions.select("graph_id", "seq", "effect", "block", "idx")


@query(_BUILT + "SELECT graph_id, top + 1 AS blocks, (SELECT count(*) FROM bedge e WHERE e.graph_id = k.graph_id) AS edges FROM bkeep k")
def build_sizes(spark, d):
    """Blocks, without those trimmed at the end, and edges of the graphs built."""
    g = builder.build(tables.streams(spark, d)).graph
    return g.node_count().join(g.edge_count(), "graph_id", "left").fillna(0, ["edges"]).select("graph_id", F.col("nodes").alias("blocks"), "edges")


@query(_FAULTY + "SELECT * FROM berr")
def build_errors(spark, d):
    """The first error of every stream that is not well formed, its scopes left as the events leave them."""
    return builder.build(tables.streams(spark, d, faulty=True)).errors


@query(with_(sql.STREAMS) + """SELECT graph_id, seq, effect, depth, scope FROM (SELECT s.*, (SELECT max(o.seq) FROM st o WHERE o.graph_id = s.graph_id AND o.effect IN ('ConditionalOpen', 'LoopOpen', 'SwitchOpen') AND o.d + 1 = s.d AND o.seq < s.seq) AS scope, d AS depth FROM st s)""")
def stream_scopes(spark, d):
    """Depth and innermost scope of every instruction of the streams."""
    return builder.enclosing(tables.streams(spark, d), builder.step_of()).select("graph_id", "seq", "effect", "depth", "scope")


# -- stored graphs ----------------------------------------------------------------------


@query(_P + """, t AS (SELECT graph_id, max(node_id) AS top FROM blk GROUP BY graph_id), n AS (SELECT graph_id, top + unnest([1, 2]) AS node_id, unnest(['exit', 'start']) AS payload FROM t)
SELECT graph_id, node_id, payload, payload = 'start' AS root FROM (SELECT graph_id, node_id, first AS payload FROM blk UNION ALL SELECT * FROM n)""")
def node_growth(spark, d):
    """Nodes after two were added to each program, and which of them is the root that was set."""
    g, _ = tables.programs(spark, d)
    new = g.roots.select("graph_id", F.explode(F.array(F.lit("start"), F.lit("exit"))).alias("payload"))
    grown = g.add_nodes(new)
    grown = grown.rooted(grown.nodes.where("payload = 'start'").select("graph_id", F.col("node_id").alias("root")))
    at = grown.roots.select("graph_id", F.col("root").alias("node_id"), F.lit(True).alias("root"))
    return grown.nodes.join(at, ["graph_id", "node_id"], "left").fillna(False, ["root"])


@query("""WITH k AS (SELECT 'org' AS s, 'r' || r_regionkey AS t FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
a AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS node_id FROM (SELECT DISTINCT s AS key FROM k)),
b AS (SELECT key, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY key) - 1 AS node_id FROM (SELECT DISTINCT t AS key FROM k WHERE t NOT IN (SELECT key FROM a)))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def ensured_keys(spark, d):
    """Ids of keys once the sources and then the targets of the tree were asked for."""
    pairs = tables.org_keys(spark, d)
    keyed = lambda c: pairs.select("graph_id", F.col(c).alias("key"), F.col(c).alias("seen")).distinct()
    known = checkpoint(graph.intern(keyed("source_key")))
    return graph.ensure_keys(known, keyed("target_key")).select("key", "node_id")


@query(_P + """, s AS (SELECT graph_id, max(edge_id) + 1 AS slots FROM pe GROUP BY graph_id)
SELECT graph_id, edge_id, src, dst, CASE WHEN edge_id % 2 = 0 THEN src + 0.5 END AS weight FROM pe UNION ALL SELECT graph_id, slots, 0, 0, 0.25 FROM s""")
def weighted_edges(spark, d):
    """Edges after every second one got a weight and a weighted one was added."""
    g, _ = tables.programs(spark, d)
    g = g.set_weight(g.edges.where("edge_id % 2 = 0").select("graph_id", "edge_id", (F.col("src") + 0.5).alias("weight")))
    new = g.edges.select("graph_id").distinct().select("graph_id", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.25).alias("weight"))
    return g.add_edges(new).edges.select("graph_id", "edge_id", "src", "dst", "weight")


@query(_P + "SELECT graph_id, edge_id, src, CASE WHEN dst % 3 = 2 THEN dst - 1 ELSE dst END AS dst FROM pe")
def redirected_edges(spark, d):
    """Edges once those into every third block go to the block before it."""
    g, _ = tables.programs(spark, d)
    return g.redirect(g.nodes.where("node_id % 3 = 2").select("graph_id", F.col("node_id").alias("old"), (F.col("node_id") - 1).alias("new"))).live().select("graph_id", "edge_id", "src", "dst")


# -- switches, calls, side tables ----------------------------------------------------------

_TOKENS = """, tok AS (SELECT graph_id, first AS token, max(node_id) AS block FROM blk GROUP BY graph_id, first), tab AS (SELECT graph_id, node_id AS block FROM blk WHERE last = 'purchase')"""


def _switches(spark, d):
    g, ins = tables.programs(spark, d)
    g = graph.Graph(g.nodes, g.edges.withColumn("kind", F.when(F.col("kind") == "Back", "IndirectJump").otherwise(F.col("kind"))), g.roots)
    is_switch = F.col("name") == "purchase"
    marked = ins.withColumn("switch_targets", F.when(is_switch, F.array(F.lit("signup"), F.lit("view"), F.lit("none")))).withColumn("switch_default", F.when(is_switch & (F.col("value") % 2 == 0), "click"))
    return g, marked, calls.switch_tables(marked)


@query(_P + """SELECT b.graph_id, node_id AS block, 'signup,view,none' AS targets, CASE WHEN i.value % 2 = 0 THEN 'click' END AS "default" FROM blk b
JOIN ins i ON i.graph_id = b.graph_id AND i.block = b.node_id AND i.name = 'purchase' WHERE b.last = 'purchase'""")
def switch_tables(spark, d):
    """Switches of the programs, if a purchase switches to a signup or a view."""
    return _switches(spark, d)[2].select("graph_id", "block", F.array_join("targets", ",").alias("targets"), "default")


@query(_P + _TOKENS + """SELECT graph_id, src, dst, kind FROM pe WHERE kind <> 'Back' UNION ALL SELECT pe.graph_id, src, dst, 'IndirectJump' FROM pe WHERE kind = 'Back' AND NOT EXISTS (SELECT 1 FROM tab WHERE tab.graph_id = pe.graph_id AND tab.block = pe.src)
UNION ALL SELECT tab.graph_id, tab.block, tok.block, 'SwitchCase' FROM tab JOIN tok ON tok.graph_id = tab.graph_id AND token IN ('signup', 'view')
UNION ALL SELECT tab.graph_id, tab.block, tok.block, 'Unconditional' FROM tab JOIN tok ON tok.graph_id = tab.graph_id AND token = 'click' JOIN ins i ON i.graph_id = tab.graph_id AND i.block = tab.block AND i.name = 'purchase' AND i.value % 2 = 0""")
def recovered_switches(spark, d):
    """Edges once the switches are resolved to the last block that begins with each token."""
    g, _, found = _switches(spark, d)
    tokens = g.nodes.groupBy("graph_id", F.col("payload").alias("token")).agg(F.max("node_id").alias("block"))
    return calls.recover_switches(g, found, tokens)


@query(_P + "SELECT graph_id, block, idx FROM ins WHERE name = 'view' AND value % 3 = 0")
def explicit_tail_calls(spark, d):
    """Calls that are marked as tail calls."""
    _, ins = tables.programs(spark, d)
    return calls.explicit_tail_calls(ins.withColumn("tail", (F.col("name") == "view") & (F.col("value") % 3 == 0)))


@query(_P + """, f AS (SELECT DISTINCT graph_id AS key FROM blk) SELECT DISTINCT key FROM f JOIN ins ON ins.value::VARCHAR = f.key""")
def found_functions(spark, d):
    """Functions of the call graph that some value names."""
    g, ins = tables.programs(spark, d)
    cg = calls.call_graph(g.roots.select(F.col("graph_id").alias("key"), "graph_id"), ins.withColumn("callee", F.lit(None).cast("string")))
    return cg.find_payload(ins.select(F.lit("calls").alias("graph_id"), F.col("value").cast("string").alias("payload")).distinct()).select(F.col("payload").alias("key"))


def _regions(spark, d):
    """Loops as regions: the header's loop is protected, its handler is entered at the header, finally or catch by turns."""
    g, _ = tables.programs(spark, d)
    bodies = checkpoint(dominance.loop_bodies(g, dominance.tree_back_edges(g, dominance.immediate_dominators(g))))
    lists = bodies.groupBy("graph_id", F.col("header").alias("key")).agg(F.collect_list("node_id").alias("protected"))
    ids = graph.intern(lists.select("graph_id", "key", F.col("key").alias("seen")))
    regions = checkpoint(ids.join(lists, ["graph_id", "key"]).select("graph_id", F.col("node_id").alias("region_id"), "protected", F.col("key").alias("entry")))
    kind = F.element_at(F.array(F.lit("Finally"), F.lit("Catch"), F.lit("Filter")), (F.col("region_id") % 3 + 1).cast("int"))
    handlers = regions.select("graph_id", "region_id", F.lit(0).cast("long").alias("pos"), "entry", kind.alias("kind"))
    return graph.Graph(g.nodes, g.edges.withColumn("kind", F.when(F.col("kind") == "ConditionalTrue", "ExceptionUnwind").otherwise(F.col("kind"))), g.roots), regions, handlers


_REGIONS = """, rg AS MATERIALIZED (SELECT graph_id, header, row_number() OVER (PARTITION BY graph_id ORDER BY header) - 1 AS region_id FROM (SELECT DISTINCT graph_id, header FROM body)),
hk AS (SELECT *, CASE region_id % 3 WHEN 0 THEN 'Cleanup' WHEN 1 THEN 'LandingPad' ELSE 'CatchSwitch' END AS kind FROM rg)"""


@query(_L + _REGIONS + """SELECT b.graph_id, b.node_id, CASE WHEN EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = b.graph_id AND pe.dst = b.node_id AND pe.kind = 'ConditionalTrue') THEN 'LandingPad' ELSE coalesce(hk.kind, 'Normal') END AS kind
FROM blk b LEFT JOIN hk ON hk.graph_id = b.graph_id AND hk.header = b.node_id""")
def exception_model(spark, d):
    """Kinds of blocks, with loops as protected regions and jumps ahead as unwinding."""
    g, _, handlers = _regions(spark, d)
    return calls.block_kinds(g, handlers)


@query(_L + _REGIONS + """SELECT graph_id, dst AS node_id, src AS block FROM pe WHERE kind = 'ConditionalTrue' UNION SELECT b.graph_id, b.header, b.n FROM body b""")
def protected_by(spark, d):
    """Blocks whose exceptions come to each handler."""
    return calls.protected_by(*_regions(spark, d))


@query(_L + _REGIONS + """, k AS (SELECT b.graph_id, b.node_id, CASE WHEN EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = b.graph_id AND pe.dst = b.node_id AND pe.kind = 'ConditionalTrue') THEN 'LandingPad' ELSE coalesce(hk.kind, 'Normal') END AS kind
FROM blk b LEFT JOIN hk ON hk.graph_id = b.graph_id AND hk.header = b.node_id) SELECT graph_id, count(*) FILTER (kind = 'LandingPad') AS pads, count(*) FILTER (kind = 'Cleanup') AS cleanups, (SELECT count(*) FROM pe WHERE pe.graph_id = k.graph_id AND kind = 'ConditionalTrue') AS unwinding FROM k GROUP BY graph_id""")
def exception_counts(spark, d):
    """Landing pads, cleanups and unwinding edges of every program."""
    g, _, handlers = _regions(spark, d)
    kinds = checkpoint(calls.block_kinds(g, handlers))
    n = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    out = g.roots.select("graph_id")
    for part in (n(calls.landing_pads(kinds), "pads"), n(calls.cleanup_blocks(kinds), "cleanups"), n(calls.exception_edges(g), "unwinding")):
        out = out.join(part, "graph_id", "left")
    return out.fillna(0)


@query(_L + _REGIONS + """SELECT rg.graph_id, rg.region_id, CASE WHEN e.o = 0 THEN 'Normal' ELSE 'Return' END AS reason, row_number() OVER (PARTITION BY rg.graph_id, rg.region_id ORDER BY e.o, e.dst) - 1 AS ord, e.dst AS resume FROM rg JOIN
(SELECT DISTINCT b.graph_id, b.header, e.dst, 0 AS o FROM body b JOIN pe e ON e.graph_id = b.graph_id AND e.src = b.n AND NOT EXISTS (SELECT 1 FROM body c WHERE c.graph_id = b.graph_id AND c.header = b.header AND c.n = e.dst)
 UNION ALL SELECT graph_id, header, header, 1 FROM rg) e ON e.graph_id = rg.graph_id AND e.header = rg.header""")
def continuations(spark, d):
    """Where the handlers of loops go on: at the loop's exits, and back at its header on return; added twice, kept once."""
    g, regions, handlers = _regions(spark, d)
    bodies = regions.select("graph_id", F.col("entry").alias("header"), F.explode("protected").alias("node_id"))
    at = handlers.select("graph_id", "region_id", "pos", F.col("entry").alias("header"))
    exits = dominance.loop_exits(g, bodies).join(at, ["graph_id", "header"]).select("graph_id", "region_id", "pos", F.col("exit").alias("ord"), F.lit("Normal").alias("reason"), F.col("exit").alias("resume"))
    back = at.select("graph_id", "region_id", "pos", F.lit(0).cast("long").alias("ord"), F.lit("Return").alias("reason"), F.col("header").alias("resume"))
    known = checkpoint(calls.add_continuations(exits.limit(0), exits))
    both = checkpoint(calls.add_continuations(calls.add_continuations(known, back), known))
    return calls.resumes_for(both, "Normal").withColumn("reason", F.lit("Normal")).unionByName(calls.resumes_for(both, "Return").withColumn("reason", F.lit("Return"))).drop("pos")


@query(_L + _REGIONS + """SELECT graph_id, region_id, CASE WHEN region_id % 2 = 0 THEN 'new' ELSE 'old' END AS filter FROM rg WHERE region_id % 5 <> 4""")
def handler_filters(spark, d):
    """A side table of handlers after setting, setting again and removing."""
    _, _, handlers = _regions(spark, d)
    key = ["graph_id", "region_id"]
    old = handlers.select(*key, F.lit("old").alias("filter"))
    now = calls.put(old, handlers.where("region_id % 2 = 0").select(*key, F.lit("new").alias("filter")), key)
    return calls.remove(now, handlers.where("region_id % 5 = 4").select(*key))


@query(_L + _REGIONS + """SELECT graph_id, region_id, header AS resume_from FROM rg""")
def cleanup_resumes(spark, d):
    """The block from which each handler's cleanup resumes, set twice."""
    _, _, handlers = _regions(spark, d)
    key = ["graph_id", "region_id"]
    first = handlers.select(*key, F.lit(0).cast("long").alias("resume_from"))
    return calls.put(first, handlers.select(*key, F.col("entry").alias("resume_from")), key)


@query(_L + _REGIONS + """, t AS (SELECT graph_id, count(*) AS n FROM rg GROUP BY graph_id) SELECT graph_id, region_id FROM rg UNION ALL SELECT graph_id, n FROM t""")
def added_regions(spark, d):
    """Regions after one more, that protects the root, was added to every program with a loop."""
    _, regions, _ = _regions(spark, d)
    more = regions.select("graph_id").distinct().withColumn("protected", F.array(F.lit(0).cast("long")))
    return calls.add_regions(regions.select("graph_id", "region_id", "protected"), more).select("graph_id", "region_id")


@query(_P + """SELECT graph_id, block, idx, name FROM ins UNION ALL SELECT graph_id, block, max(idx) + unnest([1, 2]), unnest(['first', 'second']) FROM ins GROUP BY graph_id, block""")
def pushed_instructions(spark, d):
    """Instructions after two were appended to every block."""
    g, ins = tables.programs(spark, d)
    new = g.nodes.select("graph_id", F.col("node_id").alias("block"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.lit("first").alias("name")), F.struct(F.lit(2).cast("long").alias("seq"), F.lit("second").alias("name")))).alias("i")).select("graph_id", "block", "i.*")
    return calls.push(ins.select("graph_id", "block", "idx", "seq", "name"), new).select("graph_id", "block", "idx", "name")


@query(_P + """SELECT graph_id, node_id, CASE WHEN node_id % 2 = 0 THEN 'even ' || node_id ELSE first END AS label FROM blk""")
def block_labels(spark, d):
    """Labels of blocks after every second one was set."""
    g, _ = tables.programs(spark, d)
    key = ["graph_id", "node_id"]
    own = g.nodes.select(*key, F.col("payload").alias("label"))
    return calls.put(own, g.nodes.where("node_id % 2 = 0").select(*key, F.concat(F.lit("even "), F.col("node_id").cast("string")).alias("label")), key)


# -- dominance, loops, patterns -----------------------------------------------------------

def _renamed(part: str, *names: str) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b(?!\.\w*\()", r"\g<1>2", part)


_DOM2 = _renamed(sql.DOM, "reach", "avoid", "dom", "depth", "idom", "pe")


@query(with_(sql.PROGRAMS, sql.DOM, "pe2 AS MATERIALIZED (SELECT * FROM pe WHERE NOT (kind = 'ConditionalTrue' AND edge_id % 2 = 0))", _DOM2)
+ """SELECT b.graph_id, b.node_id, x.idom AS old, y.idom2 AS new FROM blk b LEFT JOIN idom x ON x.graph_id = b.graph_id AND x.n = b.node_id LEFT JOIN idom2 y ON y.graph_id = b.graph_id AND y.n = b.node_id
WHERE x.idom IS DISTINCT FROM y.idom2""")
def changed_dominators(spark, d):
    """Immediate dominators that change when some of the jumps ahead are removed."""
    g, _ = tables.programs(spark, d)
    cut = g.remove_edges(g.edges.where("kind = 'ConditionalTrue' and edge_id % 2 = 0"))
    return dominance.changed_dominators(dominance.immediate_dominators(g), dominance.immediate_dominators(cut))


_TAGGED = with_(sql.PROGRAMS, sql.DOM, sql.LOOPS.replace("SELECT DISTINCT e.graph_id, e.src, e.dst FROM pe e WHERE e.src = e.dst OR", "SELECT DISTINCT e.graph_id, e.src, e.dst FROM pe e WHERE e.kind IN ('Back', 'ConditionalTrue') OR e.src = e.dst OR"))


@query(_TAGGED + "SELECT k.graph_id, k.node_id, count(b.header) AS depth FROM blk k LEFT JOIN body b ON b.graph_id = k.graph_id AND b.n = k.node_id GROUP BY ALL")
def tagged_loops(spark, d):
    """How many loops hold each block, if jumps ahead are tagged as back edges, too."""
    g, _ = tables.programs(spark, d)
    tagged = graph.Graph(g.nodes, g.edges.withColumn("kind", F.when(F.col("kind") == "ConditionalTrue", "Back").otherwise(F.col("kind"))), g.roots)
    backs = checkpoint(dominance.tree_back_edges(tagged, dominance.immediate_dominators(tagged), tagged=True))
    return dominance.nesting_depth(tagged, dominance.loop_bodies(tagged, backs))


_EMPTY = _P + """, kept AS MATERIALIZED (SELECT * FROM ins WHERE name NOT IN ('view', 'click', 'signup')), empty AS MATERIALIZED (SELECT graph_id, node_id FROM blk b WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.graph_id = b.graph_id AND k.block = b.node_id)),
one AS MATERIALIZED (SELECT graph_id, src, min(dst) AS nxt, min(kind) AS kind FROM pe GROUP BY graph_id, src HAVING count(*) = 1)"""


@query(_EMPTY + "SELECT e.graph_id, e.node_id FROM empty e JOIN one ON one.graph_id = e.graph_id AND one.src = e.node_id")
def trampolines(spark, d):
    """Blocks without instructions and with one way out, once views, clicks and signups are gone."""
    g, ins = tables.programs(spark, d)
    return analysis.trampolines(g, ins.where("name not in ('view', 'click', 'signup')"))


@query(_EMPTY + """, byp AS MATERIALIZED (SELECT e.graph_id, e.node_id, one.nxt FROM empty e JOIN one ON one.graph_id = e.graph_id AND one.src = e.node_id WHERE e.node_id <> 0 AND e.node_id <> nxt AND kind IN ('Fallthrough', 'Unconditional')),
r(graph_id, seed, cur, hop) AS (SELECT graph_id, node_id, nxt, 1 FROM byp UNION ALL SELECT r.graph_id, r.seed, byp.nxt, hop + 1 FROM r JOIN byp ON byp.graph_id = r.graph_id AND byp.node_id = r.cur WHERE hop < 500),
t AS (SELECT graph_id, seed, arg_max(cur, hop) AS "to" FROM r GROUP BY graph_id, seed)
SELECT pe.graph_id, edge_id, src, coalesce(t."to", dst) AS dst FROM pe LEFT JOIN t ON t.graph_id = pe.graph_id AND t.seed = pe.dst WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.graph_id = pe.graph_id AND x.seed = pe.src)""")
def empty_block_bypass(spark, d):
    """Edges that skip the blocks left without instructions."""
    g, ins = tables.programs(spark, d)
    return transform.bypass_empty_blocks(g, ins.where("name not in ('view', 'click', 'signup')")).live().select("graph_id", "edge_id", "src", "dst")


@query(_P + "SELECT DISTINCT graph_id, src AS node_id FROM pe WHERE dst = src")
def self_loops(spark, d):
    """Blocks that lead to themselves."""
    return analysis.self_loops(tables.programs(spark, d)[0])


# -- aliases and live variables -----------------------------------------------------------


def _memory(spark, d):
    _, ins = tables.programs(spark, d)
    store, load = F.col("name") == "purchase", F.col("name") == "click"
    none = F.array().cast("array<string>")
    memory = F.when(store, F.col("uses")).when(load & (F.col("value") % 4 == 0), F.array(F.lit("heap"), F.lit("click"))).otherwise(none)
    return ins.withColumn("memory", memory).withColumn("stores", F.when(store & (F.col("value") % 3 == 0), F.col("uses")).otherwise(none))


_ALIAS = _P + """, ap AS MATERIALIZED (SELECT graph_id, name AS a, name AS b FROM ins UNION SELECT graph_id, before, before FROM ins WHERE before IS NOT NULL UNION SELECT graph_id, 'heap', 'click' FROM ins WHERE name = 'click' AND value % 4 = 0
UNION SELECT graph_id, before, name FROM ins WHERE name = 'purchase' AND value % 3 = 0 AND before IS NOT NULL), au AS (SELECT * FROM ap UNION SELECT graph_id, b, a FROM ap UNION SELECT graph_id, b, b FROM ap),
al(graph_id, a, r) AS (SELECT graph_id, a, a FROM au UNION SELECT l.graph_id, u.b, l.r FROM al l JOIN au u ON u.graph_id = l.graph_id AND u.a = l.a), aset AS MATERIALIZED (SELECT graph_id, a AS node, min(r) AS component FROM al GROUP BY graph_id, a)
"""


@query(_ALIAS + "SELECT * FROM aset")
def alias_sets(spark, d):
    """Variables that may share a place, if purchases store to what they use and some clicks access the heap."""
    return analysis.alias_sets(analysis.alias_pairs(_memory(spark, d)))


@query(_ALIAS + """SELECT g.graph_id, (SELECT count(DISTINCT component) FROM aset s WHERE s.graph_id = g.graph_id) AS sets, coalesce((SELECT x.component = y.component FROM aset x JOIN aset y ON y.graph_id = x.graph_id WHERE x.graph_id = g.graph_id AND x.node = 'purchase' AND y.node = 'error'), false) AS alias
FROM (SELECT DISTINCT graph_id FROM blk) g""")
def may_alias(spark, d):
    """The number of alias sets of every program, and whether purchase and error may share a place."""
    ins = _memory(spark, d)
    sets = checkpoint(analysis.alias_sets(analysis.alias_pairs(ins)))
    asked = ins.select("graph_id").distinct().select("graph_id", F.lit("purchase").alias("a"), F.lit("error").alias("b"))
    return analysis.alias_set_count(sets).join(analysis.may_alias(sets, asked).select("graph_id", "alias"), "graph_id")


@query(with_(sql.PROGRAMS, sql.LIVE) + "SELECT graph_id, v AS variable FROM live_in UNION SELECT graph_id, v FROM live_out")
def all_live_variables(spark, d):
    """Variables that are live anywhere in a program."""
    return dataflow.all_live_variables(dataflow.liveness(*tables.programs(spark, d)))


# -- values ---------------------------------------------------------------------------------

#: Views and clicks are operations on the last error; other events' results are unknown.
_VALUES = """, ni AS MATERIALIZED (SELECT * REPLACE (CASE WHEN name IN ('view', 'click') THEN 'error' ELSE before END AS before), CASE WHEN name IN ('view', 'click') THEN name END AS op FROM ins),
src AS MATERIALIZED (SELECT i.graph_id, i.block, i.idx, i.before, max({'depth': p.depth, 'idx': j.idx, 'block': j.block}) AS m FROM ni i LEFT JOIN (dom d JOIN depth p ON p.graph_id = d.graph_id AND p.n = d.d JOIN ins j ON j.graph_id = d.graph_id AND j.block = d.d)
  ON d.graph_id = i.graph_id AND d.n = i.block AND j.name = i.before AND (j.block <> i.block OR j.idx < i.idx) GROUP BY i.graph_id, i.block, i.idx, i.before),
val(graph_id, block, idx, v) AS (SELECT n.graph_id, n.block, n.idx, CASE WHEN op IS NULL THEN 'site ' || n.block || ' ' || n.idx ELSE op || '(' || coalesce('entry ' || n.before, '') || ')' END FROM ni n JOIN src s ON s.graph_id = n.graph_id AND s.block = n.block AND s.idx = n.idx WHERE op IS NULL OR s.m['block'] IS NULL
  UNION ALL SELECT n.graph_id, n.block, n.idx, n.op || '(' || v.v || ')' FROM val v JOIN src s ON s.graph_id = v.graph_id AND s.m['block'] = v.block AND s.m['idx'] = v.idx JOIN ni n ON n.graph_id = s.graph_id AND n.block = s.block AND n.idx = s.idx AND n.op IS NOT NULL),
vv AS MATERIALIZED (SELECT v.* FROM val v JOIN ni n ON n.graph_id = v.graph_id AND n.block = v.block AND n.idx = v.idx AND n.op IS NOT NULL),
red AS MATERIALIZED (SELECT graph_id, block, idx FROM vv a WHERE EXISTS (SELECT 1 FROM vv b WHERE b.graph_id = a.graph_id AND b.v = a.v AND b.block = a.block AND b.idx < a.idx)
  OR EXISTS (SELECT 1 FROM vv b JOIN dom d ON d.graph_id = b.graph_id AND d.d = b.block WHERE b.graph_id = a.graph_id AND b.v = a.v AND d.n = a.block AND b.block <> a.block))
"""
_D = with_(sql.PROGRAMS, sql.DOM)


def _operations(ins):
    is_op = F.col("name").isin("view", "click")
    return ins.withColumn("op", F.when(is_op, F.col("name"))).withColumn("uses", F.when(is_op, F.array(F.lit("error"))).otherwise(F.col("uses")))


def _numbered(spark, d):
    g, ins = tables.programs(spark, d)
    ins = _operations(ins)
    dom = dominance.dominators(g)
    names = values.value_names(ins, checkpoint(values.operand_sources(ins, dom)))
    return ins, dom, names


@query(_D + _VALUES + "SELECT a.graph_id, a.block, a.idx, (SELECT count(*) FROM vv b WHERE b.graph_id = a.graph_id AND b.v = a.v) AS same FROM vv a")
def global_values(spark, d):
    """How many instructions of a program compute each one's value, if views and clicks are operations."""
    ins, _, names = _numbered(spark, d)
    same = names.join(ins.where("op is not null"), values.SITE, "left_semi")
    return same.join(same.groupBy("graph_id", "value").agg(F.count(F.lit(1)).alias("same")), ["graph_id", "value"]).select(*values.SITE, "same")


@query(_D + _VALUES + "SELECT * FROM red")
def redundant_expressions(spark, d):
    """Expressions that a dominating instruction has computed."""
    ins, dom, names = _numbered(spark, d)
    return values.redundant(ins, names, dom)


@query(_D + _VALUES + "SELECT graph_id, count(*) AS redundant FROM red GROUP BY graph_id")
def redundant_counts(spark, d):
    """Redundant expressions of every program."""
    ins, dom, names = _numbered(spark, d)
    return values.count_redundant(values.redundant(ins, names, dom))


@query(_D + _VALUES + "SELECT graph_id, block, row_number() OVER (PARTITION BY graph_id, block ORDER BY idx) - 1 AS idx, name FROM ins i WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.graph_id = i.graph_id AND r.block = i.block AND r.idx = i.idx)")
def redundancy_elimination(spark, d):
    """Instructions left once redundant expressions are gone."""
    ins, dom, names = _numbered(spark, d)
    return values.eliminate(ins, values.redundant(ins, names, dom)).select("graph_id", "block", "idx", "name")


@query(_P + """, ni AS MATERIALIZED (SELECT * REPLACE (CASE WHEN name IN ('view', 'click') THEN 'error' ELSE before END AS before), CASE WHEN name IN ('view', 'click') THEN name END AS op FROM ins), s AS MATERIALIZED (SELECT i.graph_id, i.block, i.idx, max(j.idx) AS f FROM ni i LEFT JOIN ins j ON j.graph_id = i.graph_id AND j.block = i.block AND j.name = i.before AND j.idx < i.idx GROUP BY ALL),
val(graph_id, block, idx, v) AS (SELECT n.graph_id, n.block, n.idx, CASE WHEN op IS NULL THEN 'site ' || n.idx ELSE op || '(' || coalesce('entry ' || n.before, '') || ')' END FROM ni n JOIN s ON s.graph_id = n.graph_id AND s.block = n.block AND s.idx = n.idx WHERE op IS NULL OR f IS NULL
  UNION ALL SELECT n.graph_id, n.block, n.idx, n.op || '(' || v.v || ')' FROM val v JOIN s ON s.graph_id = v.graph_id AND s.block = v.block AND s.f = v.idx JOIN ni n ON n.graph_id = s.graph_id AND n.block = s.block AND n.idx = s.idx AND n.op IS NOT NULL)
SELECT a.graph_id, a.block, a.idx FROM val a JOIN ni n ON n.graph_id = a.graph_id AND n.block = a.block AND n.idx = a.idx AND n.op IS NOT NULL
WHERE EXISTS (SELECT 1 FROM val b WHERE b.graph_id = a.graph_id AND b.block = a.block AND b.v = a.v AND b.idx < a.idx)""")
def local_values(spark, d):
    """Expressions computed earlier in their block, nothing being known at its entry."""
    ins = _operations(tables.programs(spark, d)[1])
    return values.redundant(ins, values.value_names(ins, checkpoint(values.operand_sources(ins))))


# -- depth-first orders -----------------------------------------------------------------------

def _ranked(df, name):
    from pyspark.sql import Window as W

    return df.select("graph_id", "node_id", (F.row_number().over(W.partitionBy("graph_id").orderBy("pos")) - 1).cast("long").alias(name))


@query()
def depth_first_orders(spark, d):
    """Depth-first preorder, postorder and reverse postorder of every program's blocks."""
    g, _ = tables.programs(spark, d)
    events = checkpoint(depth_first.depth_first_events(g, g.roots.select("graph_id", F.col("root").alias("node_id"))))
    key = ["graph_id", "node_id"]
    return _ranked(depth_first.preorder(events), "preorder").join(_ranked(depth_first.postorder(events), "postorder"), key).join(_ranked(depth_first.reverse_postorder(events), "reverse_postorder"), key)


@query()
def depth_first_walk(spark, d):
    """All depth-first events of every program's blocks."""
    g, _ = tables.programs(spark, d)
    return depth_first.depth_first_events(g, g.roots.select("graph_id", F.col("root").alias("node_id")))


@query(with_(sql.PROGRAMS, "fan AS MATERIALIZED (SELECT graph_id, edge_id, src, dst, row_number() OVER (PARTITION BY graph_id, src ORDER BY edge_id) AS r FROM pe WHERE kind = 'Fallthrough' OR kind = 'ConditionalTrue')",
"pth(graph_id, n, path) AS (SELECT graph_id, node_id, [0::BIGINT] FROM blk WHERE node_id = 0 UNION ALL SELECT f.graph_id, f.dst, list_append(p.path, f.r) FROM pth p JOIN fan f ON f.graph_id = p.graph_id AND f.src = p.n AND NOT EXISTS (SELECT 1 FROM fan o WHERE o.graph_id = f.graph_id AND o.dst = f.dst AND o.edge_id < f.edge_id))")
+ "SELECT graph_id, n AS node_id, row_number() OVER (PARTITION BY graph_id ORDER BY path) - 1 AS preorder FROM pth")
def depth_first_trees(spark, d):
    """Depth-first preorder of the tree that each block's first way in, fallthrough or jump ahead, makes of a program."""
    from pyspark.sql import Window as W

    g, _ = tables.programs(spark, d)
    kept = g.live().where("kind in ('Fallthrough', 'ConditionalTrue')")
    first = F.row_number().over(W.partitionBy("graph_id", "dst").orderBy("edge_id"))
    tree = checkpoint(kept.withColumn("k", first).where("k = 1").drop("k"))
    events = depth_first.depth_first_events(graph.Graph(g.nodes, tree, g.roots), g.roots.select("graph_id", F.col("root").alias("node_id")))
    return _ranked(depth_first.preorder(events), "preorder")

