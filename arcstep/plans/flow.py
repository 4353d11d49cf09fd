"""Registered queries of conditional constants, changed dominators and keyed fixpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators import analysis, dataflow, dominance, domtree, expressions, open_search, sccp as conditional, solver, transform
from arcstep.operators.frames import checkpoint
from arcstep.plans import sql
from arcstep.plans.registry import query
from arcstep.plans.sql import with_
from arcstep.sources import tables

_P = with_(sql.PROGRAMS)

# -- constants ---------------------------------------------------------------------------

#: A view loads a number below 5, a click adds one modulo 7 to what it reads, a signup copies it; all else varies.
#: The facts of a value are all numbers that reach it, -1 for one that varies: adding one is one to one, so a value is constant if it has one fact.
_SCCP = with_(sql.PROGRAMS, sql.DOM, sql.SSA) + """,
su AS MATERIALIZED (SELECT u.graph_id, u.block, u.idx, u.before AS v, coalesce((SELECT arg_max(s.version, (q.depth, s.idx)) FROM dom d JOIN depth q ON q.graph_id = d.graph_id AND q.n = d.d
  JOIN sdef s ON s.graph_id = d.graph_id AND s.block = d.d AND s.v = u.before WHERE d.graph_id = u.graph_id AND d.n = u.block AND (d.d <> u.block OR s.idx < u.idx)), 0)::BIGINT AS version FROM ins u WHERE u.before IS NOT NULL),
site AS MATERIALIZED (SELECT i.graph_id, i.name, i.name AS v, s.version, i.value, su.v AS rv, su.version AS rver FROM ins i JOIN reach r ON r.graph_id = i.graph_id AND r.n = i.block
  JOIN sdef s ON s.graph_id = i.graph_id AND s.block = i.block AND s.idx = i.idx AND s.v = i.name AND NOT s.is_phi LEFT JOIN su ON su.graph_id = i.graph_id AND su.block = i.block AND su.idx = i.idx),
op AS MATERIALIZED (SELECT o.graph_id, o.v, s.version, o.version AS rver FROM oper o JOIN sdef s ON s.graph_id = o.graph_id AND s.block = o.block AND s.v = o.v AND s.is_phi
  JOIN reach r ON r.graph_id = o.graph_id AND r.n = o.pred),
fact(graph_id, v, version, c) AS (
  SELECT graph_id, v, version, CASE WHEN name = 'view' THEN ((value % 5) + 5) % 5 ELSE -1 END FROM site WHERE name NOT IN ('click', 'signup') OR rv IS NULL OR rver = 0
  UNION SELECT graph_id, v, version, -1 FROM op WHERE rver = 0
  UNION (SELECT s.graph_id, s.v, s.version, CASE WHEN f.c = -1 OR s.name = 'signup' THEN f.c ELSE (f.c + 1) % 7 END FROM fact f JOIN site s ON s.graph_id = f.graph_id AND s.rv = f.v AND s.rver = f.version WHERE s.name IN ('click', 'signup')
    UNION ALL SELECT o.graph_id, o.v, o.version, f.c FROM fact f JOIN op o ON o.graph_id = f.graph_id AND o.v = f.v AND o.rver = f.version))
SELECT graph_id, v AS variable, version, CASE WHEN count(*) = 1 AND min(c) <> -1 THEN 'CONST' ELSE 'BOTTOM' END AS state, CASE WHEN count(*) = 1 AND min(c) <> -1 THEN min(c) END AS value, NULL::BIGINT AS src, NULL::BIGINT AS dst FROM fact GROUP BY ALL
UNION ALL SELECT e.graph_id, NULL, NULL, 'EDGE', NULL, src, dst FROM pe e JOIN reach r ON r.graph_id = e.graph_id AND r.n = e.src
"""


def _fold(known: Column) -> Column:
    read = known[F.get("uses", F.lit(0))]
    name = F.col("name")
    value = F.when(name == "view", F.pmod("value", F.lit(5))).when(name == "click", (read + 1) % 7).when(name == "signup", read)
    return F.when(value.isNotNull(), F.struct(F.get("defs", F.lit(0)).alias("variable"), value.alias("value")))


def _fold_row(instr: dict, known: dict) -> tuple[str, int] | None:
    """The same of one instruction."""
    name, value = instr["name"], instr["value"]
    read = known.get(instr["uses"][0]) if instr["uses"] else None
    if name == "view":
        out = None if value is None else value % 5
    elif name == "click":
        out = None if read is None else (read + 1) % 7  # what is read is not negative
    else:
        out = read if name == "signup" else None
    return None if out is None else (instr["defs"][0], out)


@query(_SCCP)
def sccp(spark, d):
    """Constants of all programs' SSA values, with folding, and the executable edges."""
    g, ins = tables.programs(spark, d)
    dom = dominance.dominators(g)
    phis = checkpoint(dataflow.place_phis(g, ins, dom))
    defs = checkpoint(dataflow.ssa_definitions(ins, phis, dom))
    uses, operands = dataflow.ssa_uses(ins, defs, dom), dataflow.phi_operands(g, phis, defs, dom)
    can = F.col("name").isin("view", "click", "signup")
    reached = dom.select("graph_id", F.col("node_id").alias("block")).distinct()
    values, edges = conditional.sccp(g, ins, defs, uses, operands, _fold, can, reached=reached, fold_row=_fold_row)
    null = lambda t: F.lit(None).cast(t)
    return values.select("graph_id", "variable", "version", "state", "value", null("bigint").alias("src"), null("bigint").alias("dst")).unionByName(
        edges.select("graph_id", null("string").alias("variable"), null("bigint").alias("version"), F.lit("EDGE").alias("state"), null("bigint").alias("value"), "src", "dst")
    )


# -- changed dominators ----------------------------------------------------------------------

_CUT = _P.rstrip() + """, pf AS MATERIALIZED (SELECT * FROM pe WHERE NOT (kind = 'ConditionalTrue' AND edge_id % 5 = 0)),
cr(graph_id, n) AS (SELECT graph_id, 0::BIGINT FROM blk WHERE node_id = 0 UNION SELECT e.graph_id, e.dst FROM cr JOIN pf e ON e.graph_id = cr.graph_id AND e.src = cr.n),
ca(graph_id, x, n) AS (SELECT graph_id, n, 0::BIGINT FROM cr WHERE n <> 0 UNION SELECT a.graph_id, a.x, e.dst FROM ca a JOIN pf e ON e.graph_id = a.graph_id AND e.src = a.n WHERE e.dst <> a.x),
cd AS MATERIALIZED (SELECT a.graph_id, a.n, b.n AS d FROM cr a JOIN cr b ON a.graph_id = b.graph_id WHERE a.n = b.n OR b.n = 0 OR NOT EXISTS (SELECT 1 FROM ca v WHERE v.graph_id = a.graph_id AND v.x = b.n AND v.n = a.n)),
cp AS MATERIALIZED (SELECT graph_id, n, count(*) - 1 AS depth FROM cd GROUP BY ALL)
SELECT p.graph_id, p.n AS node_id, p.depth, (SELECT arg_max(c.d, q.depth) FROM cd c JOIN cp q ON q.graph_id = c.graph_id AND q.n = c.d WHERE c.graph_id = p.graph_id AND c.n = p.n AND c.d <> c.n) AS idom FROM cp p"""


@query(_CUT)
def updated_dominators(spark, d):
    """The dominator tree after some jumps ahead were removed, brought up to date from the tree before."""
    g, _ = tables.programs(spark, d)
    gone = g.edges.where("kind = 'ConditionalTrue' and edge_id % 5 = 0")
    tree = dominance.immediate_dominators(g)
    ends = gone.select("graph_id", "src", "dst")
    return domtree.updated_dominators(tree, g.remove_edges(gone), ends.limit(0), ends)[0]


# -- keyed fixpoints -------------------------------------------------------------------------


@query(with_(sql.PROGRAMS, sql.LIVE) + "SELECT 'in' AS side, graph_id, block AS node_id, v AS variable FROM live_in UNION ALL SELECT 'out', graph_id, block, v FROM live_out")
def solved_liveness(spark, d):
    """Liveness as a keyed fixpoint: facts are variables, backward, with gen and kill rows."""
    g, ins = tables.programs(spark, d)
    first_use = dataflow.uses(ins).groupBy("graph_id", F.col("block").alias("node_id"), F.col("variable").alias("key")).agg(F.min("idx").alias("u"))
    kill = dataflow.definitions(ins).groupBy("graph_id", F.col("block").alias("node_id"), F.col("variable").alias("key")).agg(F.min("idx").alias("d"))
    gen = first_use.join(kill, ["graph_id", "node_id", "key"], "left").where("d is null or u <= d").select("graph_id", "node_id", "key", F.lit(True).alias("fact"))
    into, out = solver.solve_keyed(g, solver.gen_kill(gen, kill.select("graph_id", "node_id", "key")), F.max, "backward")
    # Facts enter a block from behind: what is met is live at its end.
    side = lambda df, n: df.select(F.lit(n).alias("side"), "graph_id", "node_id", F.col("key").alias("variable"))
    return side(out, "in").unionByName(side(into, "out"))


@query(_P.rstrip() + """, taint(graph_id, n, h) AS (SELECT graph_id, node_id, 0::BIGINT FROM blk WHERE last = 'purchase' UNION SELECT e.graph_id, e.dst, t.h + 1 FROM taint t JOIN pe e ON e.graph_id = t.graph_id AND e.src = t.n WHERE t.h < 4)
SELECT graph_id, n AS node_id, min(h) AS hops FROM taint GROUP BY ALL""")
def seeded_facts(spark, d):
    """Least hops, up to four, from blocks that end with a purchase: a fixpoint seeded with these blocks alone."""
    g, ins = tables.programs(spark, d)
    ends = ins.groupBy("graph_id", F.col("block").alias("node_id")).agg(F.max_by("name", "idx").alias("last"))
    seeds = checkpoint(ends.where("last = 'purchase'").select("graph_id", "node_id"))
    start = seeds.select("graph_id", "node_id", F.lit("hops").alias("key"), F.lit(-1).cast("long").alias("fact"))
    step = lambda nodes, facts: facts.where("fact < 4").withColumn("fact", F.col("fact") + 1)
    _, out = solver.solve_keyed(g, step, F.min, "forward", boundary=start, seeds=seeds, types=("string", "bigint"))
    return out.select("graph_id", "node_id", F.col("fact").alias("hops"))


# -- expression trees ------------------------------------------------------------------------

#: Variables are event types by turns of five; an event reads the first and the third one before. Purchases are opaque, multiples of 7 are constants.
_EXPR = _P.rstrip() + """, xv AS MATERIALIZED (SELECT graph_id, block, idx, seq, name, value, name || (seq % 5) AS v, lag(name || (seq % 5)) OVER w AS r1, lag(name || (seq % 5), 3) OVER w AS r3,
  CASE WHEN value % 7 = 0 THEN 'CONST' WHEN name <> 'purchase' THEN 'OP' ELSE 'OPAQUE' END AS kind FROM ins WINDOW w AS (PARTITION BY graph_id ORDER BY seq)),
xr AS MATERIALIZED (SELECT graph_id, block, idx, kind, 0 AS pos, r1 AS v FROM xv WHERE r1 IS NOT NULL UNION ALL SELECT graph_id, block, idx, kind, 1, r3 FROM xv WHERE r3 IS NOT NULL),
xo AS (SELECT graph_id, block, v, max(idx) AS reader, max(pos) AS pos FROM xr GROUP BY ALL HAVING count(*) = 1 AND max(kind) = 'OP'),
xp AS MATERIALIZED (SELECT x.graph_id, x.block, x.v, max(x.idx) AS idx, max(reader) AS parent, max(pos) AS pos FROM xv x JOIN xo o ON o.graph_id = x.graph_id AND o.block = x.block AND o.v = x.v AND x.idx < o.reader GROUP BY ALL),
xroot AS (SELECT x.* FROM xv x WHERE NOT EXISTS (SELECT 1 FROM xp p WHERE p.graph_id = x.graph_id AND p.block = x.block AND p.idx = x.idx) AND NOT EXISTS (SELECT 1 FROM xv y WHERE y.graph_id = x.graph_id AND y.block = x.block AND y.v = x.v AND y.idx > x.idx)),
xt(graph_id, block, root, idx, path) AS (SELECT graph_id, block, idx, idx, []::BIGINT[] FROM xroot UNION ALL SELECT t.graph_id, t.block, t.root, p.idx, list_append(t.path, p.pos) FROM xt t JOIN xp p ON p.graph_id = t.graph_id AND p.block = t.block AND p.parent = t.idx),
xn AS MATERIALIZED (SELECT t.*, x.kind, x.name, x.value FROM xt t JOIN xv x ON x.graph_id = t.graph_id AND x.block = t.block AND x.idx = t.idx),
xk AS (SELECT graph_id, block, root, path, true AS node, CASE kind WHEN 'OP' THEN name || '(' WHEN 'CONST' THEN value::VARCHAR ELSE '?' || idx END AS s FROM xn
  UNION ALL SELECT graph_id, block, root, list_append(path, 1099511627776), false, ')' FROM xn WHERE kind = 'OP'
  UNION ALL SELECT n.graph_id, n.block, n.root, list_append(n.path, r.pos), true, r.v FROM xn n JOIN xr r ON r.graph_id = n.graph_id AND r.block = n.block AND r.idx = n.idx
    WHERE n.kind = 'OP' AND NOT EXISTS (SELECT 1 FROM xp p WHERE p.graph_id = n.graph_id AND p.block = n.block AND p.parent = n.idx AND p.pos = r.pos)),
xs AS (SELECT graph_id, block, root, max(len(path)) FILTER (node) + 1 AS depth, count(*) FILTER (node) AS nodes, string_agg(CASE WHEN node AND len(path) > 0 AND path[-1] > 0 THEN ',' ELSE '' END || s, '' ORDER BY path) AS text FROM xk GROUP BY ALL)
SELECT s.graph_id, s.block, s.root AS idx, x.v AS variable, s.depth, s.nodes, s.text FROM xs s JOIN xv x ON x.graph_id = s.graph_id AND x.block = s.block AND x.idx = s.root"""


@query(_EXPR)
def expression_trees(spark, d):
    """Expression trees of all blocks: depths, sizes and texts of the roots."""
    _, ins = tables.programs(spark, d)
    variable = F.concat("name", (F.col("seq") % 5).cast("string"))
    prog = W.partitionBy("graph_id").orderBy("seq")
    rows = ins.select(
        "graph_id", "block", "idx", F.array_compact(F.array(F.lag(variable).over(prog), F.lag(variable, 3).over(prog))).alias("uses"), F.array(variable).alias("defs"),
        F.when(F.col("value") % 7 == 0, F.col("value")).alias("constant"), F.when(F.col("name") != "purchase", F.col("name")).alias("operator"),
    )
    return expressions.expression_trees(rows)


# -- interference ----------------------------------------------------------------------------

#: Variables are event types by turns of three; what each point holds is asked point by point.
_POINTS = _P.rstrip() + """, iv AS MATERIALIZED (SELECT graph_id, block, idx, name || (seq % 3) AS d, lag(name || (seq % 3)) OVER (PARTITION BY graph_id ORDER BY seq) AS u FROM ins),
iu AS (SELECT graph_id, block, u AS v, min(idx) AS i FROM iv WHERE u IS NOT NULL GROUP BY ALL), idf AS MATERIALIZED (SELECT graph_id, block, d AS v, min(idx) AS i FROM iv GROUP BY ALL),
il(graph_id, block, v) AS (SELECT iu.graph_id, iu.block, iu.v FROM iu LEFT JOIN idf ON idf.graph_id = iu.graph_id AND idf.block = iu.block AND idf.v = iu.v WHERE idf.i IS NULL OR iu.i <= idf.i
  UNION SELECT e.graph_id, e.src, l.v FROM il l JOIN pe e ON e.graph_id = l.graph_id AND e.dst = l.block WHERE NOT EXISTS (SELECT 1 FROM idf WHERE idf.graph_id = e.graph_id AND idf.block = e.src AND idf.v = l.v)),
io AS MATERIALIZED (SELECT DISTINCT e.graph_id, e.src AS block, l.v FROM il l JOIN pe e ON e.graph_id = l.graph_id AND e.dst = l.block),
pt AS (SELECT graph_id, block, idx AS p FROM iv UNION ALL SELECT graph_id, node_id, -1 FROM blk),
vars AS (SELECT graph_id, block, u AS v FROM iv WHERE u IS NOT NULL UNION SELECT graph_id, block, d FROM iv UNION SELECT graph_id, block, v FROM io),
nxt AS (SELECT q.graph_id, q.block, q.p, x.v, (SELECT min(i.idx) FROM iv i WHERE i.graph_id = q.graph_id AND i.block = q.block AND i.idx > q.p AND i.u = x.v) AS nu,
  (SELECT min(i.idx) FROM iv i WHERE i.graph_id = q.graph_id AND i.block = q.block AND i.idx > q.p AND i.d = x.v) AS nd,
  EXISTS (SELECT 1 FROM io WHERE io.graph_id = q.graph_id AND io.block = q.block AND io.v = x.v) AS lo FROM pt q JOIN vars x ON x.graph_id = q.graph_id AND x.block = q.block),
held AS MATERIALIZED (SELECT graph_id, block, p, v FROM nxt WHERE nu IS NOT NULL AND (nd IS NULL OR nu <= nd) OR nu IS NULL AND nd IS NULL AND lo UNION SELECT graph_id, block, idx, d FROM iv)
SELECT DISTINCT a.graph_id, a.v AS a, b.v AS b FROM held a JOIN held b ON a.graph_id = b.graph_id AND a.block = b.block AND a.p = b.p AND a.v < b.v"""


@query(_POINTS)
def point_interference(spark, d):
    """Variables that hold values at one point of a block; not all that are live out of a block together."""
    g, ins = tables.programs(spark, d)
    variable = F.concat("name", (F.col("seq") % 3).cast("string"))
    before = F.lag(variable).over(W.partitionBy("graph_id").orderBy("seq"))
    rows = checkpoint(ins.select("graph_id", "block", "idx", F.array_compact(F.array(before)).alias("uses"), F.array(variable).alias("defs")))
    return analysis.interference_at_points(rows, checkpoint(dataflow.liveness(g, rows)))


# -- graphs that are not stored --------------------------------------------------------------


@query("""WITH RECURSIVE m AS (SELECT count(*) AS m FROM part), s AS (SELECT DISTINCT l_suppkey % 3 AS graph_id, l_suppkey AS key FROM lineitem WHERE l_suppkey <= 6),
r(graph_id, key, depth) USING KEY (graph_id, key) AS (SELECT graph_id, key, 0::BIGINT FROM s
  UNION SELECT graph_id, min(key) AS key, min(depth) FROM (SELECT r.graph_id, unnest([(r.key * 7 + 3) % m, r.key // 2, (r.key * r.key + 1) % m]) AS key, r.depth + 1 AS depth FROM r, m) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.graph_id = x.graph_id AND k.key = x.key) AND depth <= 12 GROUP BY graph_id, x.key),
p AS (SELECT a.graph_id, b.key, min(a.key) AS parent FROM r a, m JOIN r b ON b.graph_id = a.graph_id AND b.depth = a.depth + 1 AND b.key IN ((a.key * 7 + 3) % m, a.key // 2, (a.key * a.key + 1) % m) GROUP BY ALL)
SELECT r.graph_id, r.key, r.depth, p.parent, row_number() OVER (PARTITION BY r.graph_id ORDER BY depth, r.key) - 1 AS node_id FROM r LEFT JOIN p ON p.graph_id = r.graph_id AND p.key = r.key""")
def open_states(spark, d):
    """States up to twelve steps from some suppliers' keys; three successors of each come from arithmetic modulo the number of parts."""
    read = lambda n: tables.table(spark, d, n)
    seeds = read("lineitem").where("l_suppkey <= 6").select((F.col("l_suppkey") % 3).alias("graph_id"), F.col("l_suppkey").alias("key"))
    m = F.lit(read("part").count())

    def successors(states):
        k = F.col("key")
        return states.select("graph_id", "key", F.explode(F.array((k * 7 + 3) % m, F.expr("key div 2"), (k * k + 1) % m)).alias("next"))

    return open_search.open_search(seeds, successors, max_states=1_000_000, max_depth=12)


# -- memory ----------------------------------------------------------------------------------

_MEM_AT = """coalesce((SELECT arg_max(s.version, (q.depth, s.idx)) FROM dom d JOIN depth q ON q.graph_id = d.graph_id AND q.n = d.d
JOIN sdef s ON s.graph_id = d.graph_id AND s.block = d.d AND s.v = u.m WHERE d.graph_id = u.graph_id AND d.n = u.block AND (d.d <> u.block OR s.idx < u.idx)), 0)::BIGINT"""
_MEM = with_(
    sql.PROGRAMS, sql.DOM, "mins AS MATERIALIZED (SELECT graph_id, block, idx, 'm' || (abs(value) % 2) AS name FROM ins WHERE name IN ('purchase', 'error'))", re.sub(r"\bins\b", "mins", sql.SSA)
) + f"""SELECT u.graph_id, u.block, u.idx, u.m AS memory, 'use' AS access, {_MEM_AT} AS version, NULL::BIGINT AS clobbered FROM (SELECT graph_id, block, idx, 'm' || (abs(value) % 2) AS m FROM ins WHERE name IN ('view', 'error')) u
UNION ALL SELECT u.graph_id, u.block, u.idx, u.m, CASE WHEN is_phi THEN 'phi' ELSE 'def' END, ver, CASE WHEN NOT is_phi THEN {_MEM_AT} END FROM (SELECT graph_id, block, idx, v AS m, is_phi, version AS ver FROM sdef) u"""


@query(_MEM)
def memory_versions(spark, d):
    """Memory of two alias sets: purchases write, views read, errors do both."""
    g, ins = tables.programs(spark, d)
    one = F.array(F.concat(F.lit("m"), (F.abs("value") % 2).cast("string")))
    when = lambda *names: F.when(F.col("name").isin(*names), one).otherwise(F.array().cast("array<string>"))
    rows = ins.select("graph_id", "block", "idx", when("view", "error").alias("reads"), when("purchase", "error").alias("writes"))
    return dataflow.memory_ssa(g, rows, dominance.dominators(g))[0]


# -- clean-up --------------------------------------------------------------------------------


@query()
def simplified_programs(spark, d):
    """Edges that are left once views, clicks and signups are gone and clean-up moves nothing any more."""
    g, ins = tables.programs(spark, d)
    return transform.simplify(g, ins.where("name not in ('view', 'click', 'signup')"))[0].live().select("graph_id", "edge_id", "src", "dst", "kind")
