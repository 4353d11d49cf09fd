"""Written tables and their sizes in plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcstep.operators import frames
from arcstep.operators.frames import checkpoint


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_table_that_shrinks_in_files_is_not_broadcast(spark):
    rows = spark.range(400_000).select(F.lit("g").alias("graph_id"), (F.abs(F.xxhash64("id")) % 1000).alias("node_id"), F.lit("signup").alias("payload"))
    large, small = checkpoint(rows), checkpoint(rows.limit(5))
    key = ["graph_id", "node_id"]
    assert "Broadcast" not in plan(large.join(large.withColumnRenamed("payload", "other"), key, "left"))
    assert "Broadcast" in plan(large.join(small.withColumnRenamed("payload", "other"), key, "left"))


def test_a_side_of_some_megabytes_is_not_broadcast_at_run_time(spark):
    # 60,000 rows are over two megabytes in a shuffle, which is below Spark's own bound.
    rows = checkpoint(spark.range(60_000).selectExpr("cast(id % 7 as string) as graph_id", "id as node_id", "id * 3 as value"))
    for most, want in ((60_000, False), (100, True)):
        other = checkpoint(rows.withColumnRenamed("value", "other")).where(F.col("node_id") < most)
        joined = rows.join(other, ["graph_id", "node_id"])
        assert len(joined.collect()) == most
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == want


def test_a_closure_asks_what_is_known_once_in_several_steps(spark, monkeypatch):
    written = []
    real = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: written.append(1) or real(df))
    # A chain of 18 nodes with a ring at its end and a short cut.
    edges = spark.createDataFrame([(i, i + 1) for i in range(17)] + [(17, 14), (2, 9)], "src long, dst long")
    step = lambda f: f.withColumnRenamed("node_id", "src").join(edges, "src").select(F.col("dst").alias("node_id"))
    got = frames.closure(spark.sql("select 0L as node_id"), step, ["node_id"])
    assert sorted(r[0] for r in got.collect()) == list(range(18))
    assert len(written) <= 6
    deep = lambda f: f.withColumnRenamed("node_id", "src").join(edges, "src").select(F.col("dst").alias("node_id"), (F.col("depth") + 1).alias("depth"))
    far = frames.closure(spark.sql("select 0L as node_id, 0L as depth"), deep, ["node_id"], best={"depth": F.min("depth")}, hops=4)
    assert {tuple(r) for r in far.select("node_id", "depth").collect()} == {(i, i if i < 9 else i - 6) for i in range(18)}


def test_large_parts_of_a_closure_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(frames, "LARGE", 20)
    plans = []
    real = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: plans.append(plan(df)) or real(df))
    # Thirty chains of 60 nodes: each round finds more rows than the bound, and a few rounds far more than it.
    edges = real(spark.range(30 * 60).selectExpr("cast(id % 30 as string) as graph_id", "id div 30 as node_id", "id div 30 + 1 as next"))
    step = lambda f: f.join(edges, ["graph_id", "node_id"]).select("graph_id", F.col("next").alias("node_id"))
    seed = edges.where("node_id = 0").select("graph_id", "node_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = frames.closure(seed, step, ["graph_id", "node_id"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r) for r in got.collect()) == sorted((str(g), n) for g in range(30) for n in range(61))
    # What is known is read in its buckets, without being moved.
    assert any("Bucketed: true" in p and "LeftAnti" in p for p in plans)


def test_ids_of_groups_join_where_their_rows_are(spark):
    rows = spark.range(5000).selectExpr("cast(id % 3 as string) as g", "5000 - id as v").where("g <> '2' or v < 10")
    got = frames.dense_ids(rows, ["v"], "k", ["g"])
    for g in ("0", "1", "2"):
        ordered = [r["k"] for r in got.where(F.col("g") == g).orderBy("v").collect()]
        assert ordered and ordered == list(range(len(ordered)))
    # No join on the groups alone: a large group is never in one task.
    assert "[g#" not in "".join(line for line in plan(got).splitlines() if "Join" in line and "__part" not in line)


def test_links_of_hot_nodes_are_not_joined_by_them(spark, monkeypatch):
    monkeypatch.setattr(frames, "HOT", 10)
    seen = []
    real = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: seen.append(df) or real(df))
    # Two stars of 50 links whose centres are linked, and a chain.
    links = [("a", 1, i) for i in range(100, 150)] + [("a", 50, i) for i in range(200, 250)] + [("a", 1, 50)] + [("b", i, i + 1) for i in range(9)]
    got = frames.star_components(spark.createDataFrame(links, "g string, a long, b long"), ["g"], "a", "b")
    want = {("a", n, 1) for n in [1, 50, *range(100, 150), *range(200, 250)]} | {("b", n, 0) for n in range(10)}
    assert {tuple(r) for r in got.select("g", "node", "component").collect()} == want
    assert any("#" in plan(df) and "hot" in plan(df) and "BroadcastHashJoin" in plan(df) for df in seen)
