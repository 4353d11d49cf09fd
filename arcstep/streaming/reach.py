"""Reachability kept up to date while edges arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcstep.operators.frames import closure

KEY = ["graph_id", "node_id"]


def extend(reached: DataFrame, edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The nodes (graph_id, node_id) that new edges make reachable, given those reached before and all edges so far."""
    ends = edges.select("graph_id", F.col("src").alias("node_id"), "dst").distinct()
    first = new_edges.select("graph_id", F.col("src").alias("node_id"), "dst").join(reached, KEY, "left_semi")
    seeds = first.select("graph_id", F.col("dst").alias("node_id")).distinct().join(reached, KEY, "left_anti")
    step = lambda f: f.join(ends, KEY).select("graph_id", F.col("dst").alias("node_id")).join(reached, KEY, "left_anti")
    return closure(seeds, step, KEY)


def keep_reachable(edges: DataFrame, folder: str, seeds: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts a query over streaming (graph_id, src, dst) rows; ``folder``/reached and /edges hold the state as Parquet.

    Each micro-batch appends its edges and the nodes they make reachable, under
    its own batch number, so that a batch that is run again replaces its rows.
    """
    spark = seeds.sparkSession
    seeds.select(*KEY).distinct().write.mode("overwrite").parquet(f"{folder}/reached/batch=-1")

    def update(batch: DataFrame, number: int) -> None:
        rows = batch.select("graph_id", "src", "dst").distinct()
        rows.write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")
        new = spark.read.parquet(f"{folder}/edges/batch={number}")
        known = spark.read.parquet(f"{folder}/reached").where(F.col("batch") < number).select(*KEY)
        every = spark.read.parquet(f"{folder}/edges").where(F.col("batch") <= number)
        extend(known, every, new).write.mode("overwrite").parquet(f"{folder}/reached/batch={number}")

    return edges.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
