"""Graphs, programs and clauses derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcstep.operators.builder import enclosing
from arcstep.operators.frames import checkpoint, dense_ids, table
from arcstep.operators.graph import Graph, edges_of

_ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _item_flow(items: DataFrame, node: str) -> Graph:
    """Edges between the consecutive line items of each order, for every graph_id; ids follow the items' order."""
    after = F.lead(node).over(W.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER))
    pairs = items.withColumn("dst", after).where("dst is not null")
    edges = dense_ids(pairs.select("graph_id", F.col(node).alias("src"), "dst", "l_orderkey", *_ITEM_ORDER), ["l_orderkey", *_ITEM_ORDER], "edge_id", ["graph_id"])
    edges = checkpoint(edges_of(edges.select("graph_id", "edge_id", "src", "dst")))
    nodes = edges.select("graph_id", F.col("src").alias("node_id")).union(edges.select("graph_id", "dst")).distinct()
    nodes = checkpoint(nodes.withColumn("payload", F.col("node_id").cast("string")))
    top = edges.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n")).groupBy("graph_id").agg(F.min(F.struct(-F.col("n"), "src")).alias("m"))
    return Graph(nodes, edges, checkpoint(top.select("graph_id", F.col("m.src").alias("root"))))


def _items_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items, with the quarter of their order's date as graph_id."""
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), quarter.alias("graph_id"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_ITEM_ORDER).join(orders, "l_orderkey")


def part_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that follow one another in an order, a graph for each quarter: sparse, with a large cycle class; rooted at the largest out-degree."""
    return _item_flow(_items_by_quarter(spark, sf_dir), "l_partkey")


def supplier_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers that follow one another in an order: one dense, cyclic graph with parallel and self edges."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ITEM_ORDER)
    return _item_flow(items.withColumn("graph_id", F.lit("suppliers")), "l_suppkey")


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): event types that follow one another for a user."""
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("dst", after).where("dst is not null").groupBy(F.col("event_type").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


def org_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, source_key, target_key): the tree of regions, nations, customers and orders under one root."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    read = lambda n: table(spark, sf_dir, n)
    parts = [
        read("region").select(F.lit("org").alias("s"), key("r", "r_regionkey").alias("t")),
        read("nation").select(key("r", "n_regionkey"), key("n", "n_nationkey")),
        read("customer").select(key("n", "c_nationkey"), key("c", "c_custkey")),
        read("orders").select(key("c", "o_custkey"), key("o", "o_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.lit("org").alias("graph_id"), F.col("s").alias("source_key"), F.col("t").alias("target_key"))


def part_clauses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Horn clauses over parts, a set for each quarter: an order's last part follows from its other parts; small parts are axioms."""
    items = _items_by_quarter(spark, sf_dir).withColumnRenamed("graph_id", "set_id")
    last = F.last("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*_ITEM_ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = items.select("set_id", F.col("l_orderkey").alias("clause_id"), F.col("l_partkey").alias("fact"), last.alias("head"))
    heads = rows.select("set_id", "clause_id", "head").distinct()
    small = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("head"))
    axioms = rows.select("set_id", F.col("fact").alias("head")).distinct().join(small, "head", "left_semi").select("set_id", (-1 - F.col("head")).alias("clause_id"), "head")
    return heads.union(axioms), rows.where("fact <> head").select("set_id", "clause_id", "fact")


# -- programs -----------------------------------------------------------------


def programs(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Control-flow graphs: the events of a user are a program, each event an instruction.

    A block starts at the program's first event, at a signup, and after an error
    or a purchase. Control falls into the next block; an error may also jump to
    the first signup block beyond that, a purchase also loops back to the last
    signup block so far. An instruction defines its event type and uses the type
    of the event before it. Returns the graph, rooted at block 0, and the
    instructions (graph_id, block, idx, seq, name, uses, defs, effects, effect, value).
    """
    user = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("graph_id"), "ts", "event_id", "event_type", "value", (F.row_number().over(user) - 1).alias("i"))
    prog = W.partitionBy("graph_id").orderBy("i")
    e = e.withColumn("before", F.lag("event_type").over(prog))
    starts = (F.col("before").isNull() | (F.col("event_type") == "signup") | F.col("before").isin("error", "purchase")).cast("int")
    e = e.withColumn("block", (F.sum(starts).over(prog) - 1).cast("long"))
    blk = W.partitionBy("graph_id", "block").orderBy("i")
    effects = F.when(F.col("event_type") == "purchase", F.array(F.lit("io"))).when(F.col("event_type") == "error", F.array(F.lit("io"), F.lit("throw"))).otherwise(F.array().cast("array<string>"))
    effect = F.when(F.col("event_type") == "view", "Call").when(F.col("event_type") == "error", "ConditionalJump").when(F.col("event_type") == "purchase", "ConditionalJump").otherwise("Fallthrough")
    instrs = checkpoint(
        e.select(
            "graph_id", "block", (F.row_number().over(blk) - 1).cast("long").alias("idx"), (F.row_number().over(prog) - 1).cast("long").alias("seq"),
            F.col("event_type").alias("name"),
            F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array("before")).alias("uses"),
            F.array("event_type").alias("defs"), effects.alias("effects"), effect.alias("effect"), F.col("value").cast("long").alias("value"),
        )
    )
    ends = instrs.groupBy("graph_id", "block").agg(F.min_by("name", "idx").alias("first"), F.max_by("name", "idx").alias("last"))
    allb = W.partitionBy("graph_id").orderBy("block")
    signup = F.when(F.col("first") == "signup", F.col("block"))
    b = ends.select(
        "graph_id", "block", "last", F.lead("block").over(allb).alias("next"),
        F.min(signup).over(allb.rowsBetween(2, W.unboundedFollowing)).alias("ahead"),
        F.max(signup).over(allb.rowsBetween(W.unboundedPreceding, 0)).alias("behind"),
    )
    edge = lambda to, kind, k: F.when(to.isNotNull(), F.struct(to.alias("dst"), F.lit(kind).alias("kind"), F.lit(k).alias("k")))
    out = F.array(
        F.when(F.col("last") == "error", edge(F.col("ahead"), "ConditionalTrue", 0)),
        F.when(F.col("last") == "purchase", edge(F.col("behind"), "Back", 0)),
        F.when(F.col("last") == "error", edge(F.col("next"), "ConditionalFalse", 1)).otherwise(edge(F.col("next"), "Fallthrough", 1)),
    )
    e = b.select("graph_id", F.col("block").alias("src"), F.explode(F.filter(out, lambda x: x.isNotNull())).alias("e"))
    e = e.select(
        "graph_id", (F.row_number().over(W.partitionBy("graph_id").orderBy("src", "e.k")) - 1).cast("long").alias("edge_id"), "src",
        F.col("e.dst").alias("dst"), F.col("e.kind").alias("kind"),
    )
    nodes = checkpoint(ends.select("graph_id", F.col("block").alias("node_id"), F.col("first").alias("payload")))
    roots = nodes.where("node_id = 0").select("graph_id", F.col("node_id").alias("root"))
    return Graph(nodes, checkpoint(edges_of(e)), roots), instrs


def streams(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """Streams of structured instructions (graph_id, seq, effect, name, value): the events of a user.

    A signup opens a conditional, loop or switch, by its value; a purchase closes
    the innermost one; a click is an else or a case inside a conditional or switch;
    an error breaks, continues, returns, jumps or labels, by its value and place.
    Scopes left open are closed at the end, unless ``faulty`` asks for errors.
    """
    user = W.partitionBy("graph_id").orderBy("seq")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("graph_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        F.col("event_type").alias("name"), F.col("value").cast("long").alias("value"),
    )
    raw = F.when(F.col("name") == "signup", 1).when(F.col("name") == "purchase", -1).otherwise(0)
    e = e.withColumn("sum", F.sum(raw).over(user))
    least = F.coalesce(F.min("sum").over(user.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("step", F.when((F.col("name") == "purchase") & (F.col("sum") < F.least(least, F.lit(0))), 0).otherwise(raw)).drop("sum")
    kinds = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("value", F.lit(len(names))) + 1).cast("int"))
    e = checkpoint(enclosing(e, F.col("step")).withColumn("opens", F.when(F.col("step") == 1, kinds("If", "Loop", "Switch"))))
    opened = e.where("step = 1").select("graph_id", F.col("seq").alias("scope"), F.col("opens").alias("kind"))
    e = e.join(opened, ["graph_id", "scope"], "left")
    closes = F.when(F.col("kind") == "If", "ConditionalClose").when(F.col("kind") == "Loop", "LoopClose").otherwise("SwitchClose")
    inside = F.col("kind").isin("Loop", "Switch")
    effect = (
        F.when(F.col("step") == 1, F.when(F.col("opens") == "If", "ConditionalOpen").when(F.col("opens") == "Loop", "LoopOpen").otherwise("SwitchOpen"))
        .when(F.col("step") == -1, closes)
        .when((F.col("name") == "click") & (F.col("kind") == "If"), "ConditionalAlternate")
        .when((F.col("name") == "click") & (F.col("kind") == "Switch"), "SwitchCase")
        .when((F.col("name") == "error") & inside, F.when(F.col("kind") == "Loop", kinds("Break", "ConditionalContinue", "ConditionalBreak", "Continue", "Return", "Label")).otherwise(kinds("Break", "ConditionalBreak", "Label")))
        .when(F.col("name") == "error", kinds("ConditionalReturn", "Jump", "ConditionalJump", "Label", "Terminate", "Call"))
        .otherwise("Fallthrough")
    )
    if faulty:
        effect = F.when((F.col("name") == "error") & F.col("kind").isNull() & (F.col("value") % 9 == 0), "Continue").otherwise(effect)
    out = e.select("graph_id", "seq", effect.alias("effect"), "name", "value")
    if faulty:
        return checkpoint(out)
    # The scopes that no purchase closed, innermost first.
    closed = e.where("step = -1").select("graph_id", "scope")
    ends = opened.join(closed, ["graph_id", "scope"], "left_anti")
    top = e.groupBy("graph_id").agg(F.max("seq").alias("top"))
    tail = ends.withColumn("k", F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("scope")))).join(top, "graph_id")
    tail = tail.select("graph_id", (F.col("top") + F.col("k")).alias("seq"), closes.alias("effect"), F.lit("end").alias("name"), F.lit(0).cast("long").alias("value"))
    return checkpoint(out.unionByName(tail))
