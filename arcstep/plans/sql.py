"""DuckDB common table expressions that derive the same graphs and programs as ``sources.tables``."""

from __future__ import annotations

#: part_q: line items with the quarter of their order; part_e (graph_id, edge_id, src, dst), part_n (graph_id, node_id) and part_root (graph_id, root).
PARTS = """
part_q AS (SELECT l.*, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS graph_id FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
part_i AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM part_q),
part_e AS MATERIALIZED (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS edge_id,
  l_partkey AS src, dst FROM part_i WHERE dst IS NOT NULL),
part_n AS MATERIALIZED (SELECT graph_id, src AS node_id FROM part_e UNION SELECT graph_id, dst FROM part_e),
part_root AS MATERIALIZED (SELECT graph_id, arg_min(src, (-n, src)) AS root FROM (SELECT graph_id, src, count(*) AS n FROM part_e GROUP BY graph_id, src) GROUP BY graph_id)
"""

#: part_bfs (graph_id, node_id, depth) from the roots.
PARTS_BFS = """
part_bfs(graph_id, node_id, depth) USING KEY (graph_id, node_id) AS (
  SELECT graph_id, root, 0::BIGINT FROM part_root
  UNION SELECT r.graph_id, e.dst, r.depth + 1 FROM part_bfs r JOIN part_e e ON r.graph_id = e.graph_id AND r.node_id = e.src
    LEFT JOIN recurring.part_bfs k ON k.graph_id = e.graph_id AND k.node_id = e.dst WHERE k.node_id IS NULL)
"""

#: ins (graph_id, block, idx, seq, name, before, value), blk (graph_id, node_id, first, last) and pe (graph_id, edge_id, src, dst, kind).
PROGRAMS = """
ev0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
ev1 AS (SELECT *, user_id::VARCHAR AS graph_id FROM ev0),
ev2 AS (SELECT *, lag(event_type) OVER (PARTITION BY graph_id ORDER BY i) AS before FROM ev1),
ev3 AS (SELECT *, (sum(CASE WHEN before IS NULL OR event_type = 'signup' OR before IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY i) - 1)::BIGINT AS block FROM ev2),
ins AS MATERIALIZED (SELECT graph_id, block, row_number() OVER (PARTITION BY graph_id, block ORDER BY i) - 1 AS idx, row_number() OVER (PARTITION BY graph_id ORDER BY i) - 1 AS seq,
  event_type AS name, before, trunc(value)::BIGINT AS value FROM ev3),
blk AS MATERIALIZED (SELECT graph_id, block AS node_id, arg_min(name, idx) AS first, arg_max(name, idx) AS last FROM ins GROUP BY graph_id, block),
blk2 AS (SELECT *, lead(node_id) OVER w AS nxt,
  min(CASE WHEN first = 'signup' THEN node_id END) OVER (w ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
  max(CASE WHEN first = 'signup' THEN node_id END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS behind
  FROM blk WINDOW w AS (PARTITION BY graph_id ORDER BY node_id)),
pe AS MATERIALIZED (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src, k) - 1 AS edge_id, src, dst, kind FROM (
  SELECT graph_id, node_id AS src, ahead AS dst, 'ConditionalTrue' AS kind, 0 AS k FROM blk2 WHERE last = 'error' AND ahead IS NOT NULL
  UNION ALL SELECT graph_id, node_id, behind, 'Back', 0 FROM blk2 WHERE last = 'purchase' AND behind IS NOT NULL
  UNION ALL SELECT graph_id, node_id, nxt, CASE WHEN last = 'error' THEN 'ConditionalFalse' ELSE 'Fallthrough' END, 1 FROM blk2 WHERE nxt IS NOT NULL))
"""

#: reach (graph_id, n) and dom (graph_id, n, d): d dominates n when n cannot be reached without d.
DOM = """
reach(graph_id, n) AS (SELECT graph_id, 0::BIGINT FROM blk WHERE node_id = 0 UNION SELECT e.graph_id, e.dst FROM reach r JOIN pe e ON e.graph_id = r.graph_id AND e.src = r.n),
avoid(graph_id, x, n) AS (SELECT graph_id, n, 0::BIGINT FROM reach WHERE n <> 0
  UNION SELECT a.graph_id, a.x, e.dst FROM avoid a JOIN pe e ON e.graph_id = a.graph_id AND e.src = a.n WHERE e.dst <> a.x),
dom AS MATERIALIZED (SELECT a.graph_id, a.n, b.n AS d FROM reach a JOIN reach b ON a.graph_id = b.graph_id
  WHERE a.n = b.n OR b.n = 0 OR NOT EXISTS (SELECT 1 FROM avoid v WHERE v.graph_id = a.graph_id AND v.x = b.n AND v.n = a.n)),
depth AS MATERIALIZED (SELECT graph_id, n, count(*) - 1 AS depth FROM dom GROUP BY graph_id, n),
idom AS MATERIALIZED (SELECT d.graph_id, d.n, arg_max(d.d, p.depth) AS idom FROM dom d JOIN depth p ON p.graph_id = d.graph_id AND p.n = d.d WHERE d.n <> d.d GROUP BY d.graph_id, d.n)
"""

#: pdom (graph_id, n, d) over reversed edges; -1 is the virtual exit.
PDOM = """
exits0 AS (SELECT graph_id, node_id FROM blk b WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.graph_id = b.graph_id AND pe.src = b.node_id)),
exits AS MATERIALIZED (SELECT * FROM exits0 UNION ALL SELECT graph_id, max(node_id) FROM blk b WHERE NOT EXISTS (SELECT 1 FROM exits0 x WHERE x.graph_id = b.graph_id) GROUP BY graph_id),
re AS MATERIALIZED (SELECT graph_id, dst AS src, src AS dst FROM pe UNION ALL SELECT graph_id, -1, node_id FROM exits),
preach(graph_id, n) AS (SELECT DISTINCT graph_id, -1::BIGINT FROM exits UNION SELECT e.graph_id, e.dst FROM preach r JOIN re e ON e.graph_id = r.graph_id AND e.src = r.n),
pavoid(graph_id, x, n) AS (SELECT graph_id, n, -1::BIGINT FROM preach WHERE n <> -1
  UNION SELECT a.graph_id, a.x, e.dst FROM pavoid a JOIN re e ON e.graph_id = a.graph_id AND e.src = a.n WHERE e.dst <> a.x),
pdom AS MATERIALIZED (SELECT a.graph_id, a.n, b.n AS d FROM preach a JOIN preach b ON a.graph_id = b.graph_id
  WHERE a.n <> -1 AND b.n <> -1 AND (a.n = b.n OR NOT EXISTS (SELECT 1 FROM pavoid v WHERE v.graph_id = a.graph_id AND v.x = b.n AND v.n = a.n)))
"""

#: backs (graph_id, src, dst) by dominance and body (graph_id, header, n) of natural loops.
LOOPS = """
backs AS MATERIALIZED (SELECT DISTINCT e.graph_id, e.src, e.dst FROM pe e WHERE e.src = e.dst OR EXISTS (SELECT 1 FROM dom WHERE dom.graph_id = e.graph_id AND n = e.src AND d = e.dst)),
body(graph_id, header, n) AS (
  SELECT graph_id, dst, src FROM backs UNION SELECT graph_id, dst, dst FROM backs
  UNION SELECT b.graph_id, b.header, e.src FROM body b JOIN pe e ON e.graph_id = b.graph_id AND e.dst = b.n WHERE b.n <> b.header)
"""

#: reach_out (graph_id, block, db, di, v) and reach_in: definitions that leave and enter blocks.
REACHING = """
lastdef AS MATERIALIZED (SELECT graph_id, block, name AS v, max(idx) AS di FROM ins GROUP BY ALL),
reach_out(graph_id, block, db, di, v) AS (SELECT graph_id, block, block, di, v FROM lastdef
  UNION SELECT r.graph_id, e.dst, r.db, r.di, r.v FROM reach_out r JOIN pe e ON e.graph_id = r.graph_id AND e.src = r.block
  WHERE NOT EXISTS (SELECT 1 FROM lastdef k WHERE k.graph_id = e.graph_id AND k.block = e.dst AND k.v = r.v)),
reach_in AS MATERIALIZED (SELECT DISTINCT r.graph_id, e.dst AS block, r.db, r.di, r.v FROM reach_out r JOIN pe e ON e.graph_id = r.graph_id AND e.src = r.block)
"""

#: du (graph_id, variable, def_block, def_idx, use_block, use_idx).
DEF_USE = """
du AS MATERIALIZED (
  SELECT u.graph_id, u.before AS variable, u.block AS def_block, (SELECT max(d.idx) FROM ins d WHERE d.graph_id = u.graph_id AND d.block = u.block AND d.name = u.before AND d.idx < u.idx) AS def_idx, u.block AS use_block, u.idx AS use_idx
  FROM ins u WHERE u.before IS NOT NULL AND EXISTS (SELECT 1 FROM ins d WHERE d.graph_id = u.graph_id AND d.block = u.block AND d.name = u.before AND d.idx < u.idx)
  UNION SELECT u.graph_id, u.before, r.db, r.di, u.block, u.idx FROM ins u JOIN reach_in r ON r.graph_id = u.graph_id AND r.block = u.block AND r.v = u.before
  WHERE NOT EXISTS (SELECT 1 FROM ins d WHERE d.graph_id = u.graph_id AND d.block = u.block AND d.name = u.before AND d.idx < u.idx))
"""

#: live_in and live_out (graph_id, block, v).
LIVE = """
fu AS (SELECT graph_id, block, before AS v, min(idx) AS u FROM ins WHERE before IS NOT NULL GROUP BY ALL),
fd AS MATERIALIZED (SELECT graph_id, block, name AS v, min(idx) AS d FROM ins GROUP BY ALL),
live_in(graph_id, block, v) AS (SELECT fu.graph_id, fu.block, fu.v FROM fu LEFT JOIN fd ON fd.graph_id = fu.graph_id AND fd.block = fu.block AND fd.v = fu.v WHERE d IS NULL OR u <= d
  UNION SELECT e.graph_id, e.src, l.v FROM live_in l JOIN pe e ON e.graph_id = l.graph_id AND e.dst = l.block
  WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.graph_id = e.graph_id AND fd.block = e.src AND fd.v = l.v)),
live_out AS MATERIALIZED (SELECT DISTINCT e.graph_id, e.src AS block, l.v FROM live_in l JOIN pe e ON e.graph_id = l.graph_id AND e.dst = l.block)
"""

#: df (graph_id, n, frontier), phi (graph_id, block, v), sdef (graph_id, v, block, idx, is_phi, version).
SSA = """
joins AS (SELECT graph_id, dst AS b FROM pe GROUP BY ALL HAVING count(*) > 1),
df AS MATERIALIZED (SELECT DISTINCT e.graph_id, coalesce(d.d, e.src) AS n, e.dst AS frontier FROM pe e JOIN joins j ON j.graph_id = e.graph_id AND j.b = e.dst LEFT JOIN dom d ON d.graph_id = e.graph_id AND d.n = e.src
  WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.graph_id = e.graph_id AND s.n = e.dst AND s.d = coalesce(d.d, e.src) AND s.d <> s.n)),
phi0(graph_id, block, v) AS (SELECT f.graph_id, f.frontier, i.name FROM ins i JOIN df f ON f.graph_id = i.graph_id AND f.n = i.block
  UNION SELECT f.graph_id, f.frontier, p.v FROM phi0 p JOIN df f ON f.graph_id = p.graph_id AND f.n = p.block),
phi AS MATERIALIZED (SELECT * FROM phi0),
path AS (SELECT d.graph_id, d.n AS block, list(d.d ORDER BY p.depth) AS path FROM dom d JOIN depth p ON p.graph_id = d.graph_id AND p.n = d.d GROUP BY ALL),
sdef AS MATERIALIZED (SELECT m.graph_id, v, m.block, idx, is_phi, row_number() OVER (PARTITION BY m.graph_id, v ORDER BY path IS NULL, path, m.block, idx) AS version
  FROM (SELECT graph_id, block, -1::BIGINT AS idx, v, true AS is_phi FROM phi UNION ALL SELECT graph_id, block, idx, name, false FROM ins) m LEFT JOIN path ON path.graph_id = m.graph_id AND path.block = m.block),
oper AS MATERIALIZED (SELECT p.graph_id, p.block, p.v, e.edge_id, e.src AS pred, coalesce((SELECT arg_max(s.version, (q.depth, s.idx)) FROM dom d JOIN depth q ON q.graph_id = d.graph_id AND q.n = d.d
    JOIN sdef s ON s.graph_id = d.graph_id AND s.block = d.d AND s.v = p.v WHERE d.graph_id = p.graph_id AND d.n = e.src), 0)::BIGINT AS version
  FROM phi p JOIN pe e ON e.graph_id = p.graph_id AND e.dst = p.block)
"""


_STREAMS = """
sv AS (SELECT user_id::VARCHAR AS graph_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS name, trunc(value)::BIGINT AS value FROM events),
ss AS (SELECT *, CASE name WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS raw, sum(CASE name WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY seq) AS s FROM sv),
sm AS (SELECT *, coalesce(min(s) OVER (PARTITION BY graph_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM ss),
sp AS (SELECT graph_id, seq, name, value, CASE WHEN raw = -1 AND s < least(lo, 0) THEN 0 ELSE raw END AS step FROM sm),
sd AS MATERIALIZED (SELECT *, (sum(step) OVER (PARTITION BY graph_id ORDER BY seq) - step)::BIGINT AS depth, CASE WHEN step = 1 THEN ['If', 'Loop', 'Switch'][value % 3 + 1] END AS opens FROM sp),
so AS MATERIALIZED (SELECT d.*, (SELECT max(o.seq) FROM sd o WHERE o.graph_id = d.graph_id AND o.step = 1 AND o.depth + 1 = d.depth AND o.seq < d.seq) AS scope FROM sd d),
sk AS MATERIALIZED (SELECT a.*, o.opens AS kind FROM so a LEFT JOIN so o ON o.graph_id = a.graph_id AND o.seq = a.scope),
se AS MATERIALIZED (SELECT graph_id, seq, name, value, CASE WHEN step = 1 THEN CASE opens WHEN 'If' THEN 'ConditionalOpen' WHEN 'Loop' THEN 'LoopOpen' ELSE 'SwitchOpen' END
  WHEN step = -1 THEN CASE kind WHEN 'If' THEN 'ConditionalClose' WHEN 'Loop' THEN 'LoopClose' ELSE 'SwitchClose' END
  WHEN name = 'click' AND kind = 'If' THEN 'ConditionalAlternate' WHEN name = 'click' AND kind = 'Switch' THEN 'SwitchCase'
  WHEN name = 'error' AND kind = 'Loop' THEN ['Break', 'ConditionalContinue', 'ConditionalBreak', 'Continue', 'Return', 'Label'][value % 6 + 1]
  WHEN name = 'error' AND kind = 'Switch' THEN ['Break', 'ConditionalBreak', 'Label'][value % 3 + 1]
  {fault}
  WHEN name = 'error' THEN ['ConditionalReturn', 'Jump', 'ConditionalJump', 'Label', 'Terminate', 'Call'][value % 6 + 1] ELSE 'Fallthrough' END AS effect FROM sk),
sx AS MATERIALIZED (SELECT graph_id, seq, effect FROM se {tail}),
st AS MATERIALIZED (SELECT *, (sum(q) OVER (PARTITION BY graph_id ORDER BY seq) - q)::BIGINT AS d FROM (SELECT *, CASE WHEN effect IN ('ConditionalOpen', 'LoopOpen', 'SwitchOpen') THEN 1 WHEN effect IN ('ConditionalClose', 'LoopClose', 'SwitchClose') THEN -1 ELSE 0 END AS q FROM sx))
"""
_TAIL = """UNION ALL SELECT o.graph_id, (SELECT max(seq) FROM sk m WHERE m.graph_id = o.graph_id) + row_number() OVER (PARTITION BY o.graph_id ORDER BY o.seq DESC), CASE o.opens WHEN 'If' THEN 'ConditionalClose' WHEN 'Loop' THEN 'LoopClose' ELSE 'SwitchClose' END
  FROM sk o WHERE o.step = 1 AND NOT EXISTS (SELECT 1 FROM sk c WHERE c.graph_id = o.graph_id AND c.step = -1 AND c.scope = o.seq)"""

#: st (graph_id, seq, effect, q, d): streams of structured instructions, with the step q of the depth and the depth d before each.
STREAMS = _STREAMS.replace("{fault}", "").replace("{tail}", _TAIL)
FAULTY_STREAMS = _STREAMS.replace("{fault}", "WHEN name = 'error' AND kind IS NULL AND value % 9 = 0 THEN 'Continue'").replace("{tail}", "")

#: berr, bedge, bst and bkeep: errors, edges, instructions and last blocks of the graphs built from st.
BUILT = """
b0 AS MATERIALIZED (SELECT *, after - n AS before FROM (SELECT *, (sum(n) OVER (PARTITION BY graph_id ORDER BY seq))::BIGINT AS after FROM (SELECT *, CASE WHEN effect IN ('ConditionalBreak', 'ConditionalReturn') THEN 2 WHEN effect IN ('Fallthrough', 'Call') THEN 0 ELSE 1 END AS n FROM st))),
b1 AS MATERIALIZED (SELECT b.*, (SELECT max(o.seq) FROM b0 o WHERE o.graph_id = b.graph_id AND o.q = 1 AND o.d + 1 = b.d AND o.seq < b.seq) AS scope FROM b0 b),
bsc AS MATERIALIZED (SELECT o.graph_id, o.seq AS scope, o.scope AS parent, CASE o.effect WHEN 'ConditionalOpen' THEN 'If' WHEN 'SwitchOpen' THEN 'Switch' ELSE 'Loop' END AS kind, o.before AS pre, o.after AS header, c.before AS last, c.after AS merge, c.seq AS closed
  FROM b1 o LEFT JOIN b1 c ON c.graph_id = o.graph_id AND c.scope = o.seq AND c.q = -1 WHERE o.q = 1),
banc(graph_id, scope, a) AS (SELECT graph_id, scope, scope FROM bsc UNION ALL SELECT x.graph_id, x.scope, s.parent FROM banc x JOIN bsc s ON s.graph_id = x.graph_id AND s.scope = x.a WHERE s.parent IS NOT NULL),
bnear AS MATERIALIZED (SELECT x.graph_id, x.scope, max(x.a) FILTER (s.kind <> 'If') AS broken, max(x.a) FILTER (s.kind = 'Loop') AS loop FROM banc x JOIN bsc s ON s.graph_id = x.graph_id AND s.scope = x.a GROUP BY ALL),
b2 AS MATERIALIZED (SELECT b.*, s.kind, s.pre, s.header, n.broken, n.loop FROM b1 b LEFT JOIN bsc s ON s.graph_id = b.graph_id AND s.scope = b.scope LEFT JOIN bnear n ON n.graph_id = b.graph_id AND n.scope = b.scope),
bbad AS (SELECT graph_id, min(seq) AS seq, arg_min(CASE effect WHEN 'Break' THEN 'BreakOutsideScope' WHEN 'ConditionalBreak' THEN 'BreakOutsideScope' ELSE 'ContinueOutsideLoop' END, seq) AS error FROM b2
  WHERE effect IN ('Break', 'ConditionalBreak') AND broken IS NULL OR effect IN ('Continue', 'ConditionalContinue') AND loop IS NULL GROUP BY graph_id),
berr AS MATERIALIZED (SELECT graph_id, seq, error, 0::BIGINT AS remaining FROM bbad UNION ALL SELECT graph_id, NULL, 'UnclosedScopes', sum(q)::BIGINT FROM st WHERE graph_id NOT IN (SELECT graph_id FROM bbad) GROUP BY graph_id HAVING sum(q) > 0),
b3 AS MATERIALIZED (SELECT * FROM b2 WHERE graph_id NOT IN (SELECT graph_id FROM berr)),
bs3 AS MATERIALIZED (SELECT * FROM bsc WHERE graph_id NOT IN (SELECT graph_id FROM berr)),
be AS MATERIALIZED (
  SELECT graph_id, seq AS made, 0 AS k, 0 AS p, before AS src, after AS dst, CASE effect WHEN 'ConditionalOpen' THEN 'ConditionalTrue' WHEN 'SwitchOpen' THEN 'SwitchCase' ELSE 'Fallthrough' END AS kind FROM b3 WHERE effect IN ('ConditionalOpen', 'SwitchOpen', 'LoopOpen', 'Label')
  UNION ALL SELECT graph_id, seq, 0, 0, pre, after, CASE effect WHEN 'SwitchCase' THEN 'SwitchCase' ELSE 'ConditionalFalse' END FROM b3 WHERE effect IN ('ConditionalAlternate', 'SwitchCase')
  UNION ALL SELECT b.graph_id, seq, 0, 0, before, s.header, CASE effect WHEN 'ConditionalContinue' THEN 'ConditionalTrue' ELSE 'Back' END FROM b3 b JOIN bs3 s ON s.graph_id = b.graph_id AND s.scope = CASE WHEN effect = 'LoopClose' THEN b.scope ELSE b.loop END WHERE effect IN ('LoopClose', 'Continue', 'ConditionalContinue')
  UNION ALL SELECT graph_id, seq, 0, 0, before, before + 1, 'ConditionalTrue' FROM b3 WHERE effect IN ('ConditionalBreak', 'ConditionalReturn')
  UNION ALL SELECT graph_id, seq, 1, 0, before, after, 'ConditionalFalse' FROM b3 WHERE effect IN ('ConditionalBreak', 'ConditionalReturn', 'ConditionalContinue', 'ConditionalJump')
  UNION ALL SELECT s.graph_id, s.closed, 1, b.seq, b.before, s.merge, 'Fallthrough' FROM b3 b JOIN bs3 s ON s.graph_id = b.graph_id AND s.scope = b.scope WHERE effect IN ('ConditionalAlternate', 'SwitchCase')
  UNION ALL SELECT graph_id, closed, 2, 0, last, merge, 'Fallthrough' FROM bs3 WHERE kind <> 'Loop'
  UNION ALL SELECT graph_id, closed, 3, 0, pre, merge, 'ConditionalFalse' FROM bs3 s WHERE kind = 'If' AND NOT EXISTS (SELECT 1 FROM b3 b WHERE b.graph_id = s.graph_id AND b.scope = s.scope AND b.effect = 'ConditionalAlternate')
  UNION ALL SELECT s.graph_id, s.closed, 4, b.seq, CASE effect WHEN 'Break' THEN b.before ELSE b.before + 1 END, s.merge, 'Unconditional' FROM b3 b JOIN bs3 s ON s.graph_id = b.graph_id AND s.scope = b.broken WHERE effect IN ('Break', 'ConditionalBreak')),
bst AS MATERIALIZED (SELECT graph_id, seq, effect, CASE WHEN effect IN ('ConditionalAlternate', 'SwitchCase', 'Label') THEN after ELSE before END AS block FROM b3 WHERE q >= 0),
bkeep AS MATERIALIZED (SELECT graph_id, max(b) AS top FROM (SELECT graph_id, 0 AS b FROM b3 UNION ALL SELECT graph_id, block FROM bst UNION ALL SELECT graph_id, dst FROM be) GROUP BY graph_id),
bedge AS MATERIALIZED (SELECT be.graph_id, row_number() OVER (PARTITION BY be.graph_id ORDER BY made, k, p) - 1 AS edge_id, src, dst, kind FROM be JOIN bkeep t ON t.graph_id = be.graph_id WHERE src <= top)
"""


def with_(*parts: str) -> str:
    """A WITH RECURSIVE clause of the given expressions."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"
