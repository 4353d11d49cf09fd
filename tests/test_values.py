"""Value numbering inside blocks."""

from __future__ import annotations

from arcstep.operators import values


def test_reads_of_a_long_block_are_not_paired_with_its_definitions(spark):
    rows = spark.range(6).selectExpr("'g' as graph_id", "0L as block", "id as idx", "if(id = 0, array('y'), array('x', 'x')) as uses", "if(id % 2 = 1, array('x'), array('z')) as defs")
    got = values.operand_sources(rows)
    # An instruction reads before it writes.
    want = {(0, 0, "y", None)} | {(i, p, "x", s) for i, s in ((1, None), (2, 1), (3, 1), (4, 3), (5, 3)) for p in (0, 1)}
    assert {(r.idx, r.pos, r.variable, r.from_idx) for r in got.collect()} == want
    assert {r.from_block for r in got.where("from_idx is not null").collect()} == {0}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
