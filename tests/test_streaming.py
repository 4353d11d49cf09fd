"""Streaming reachability against the batch operator."""

from __future__ import annotations

import random

from arcstep.streaming.reach import keep_reachable


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    edges = [("g", rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    for k in range(3):
        spark.createDataFrame(edges[20 * k : 20 * k + 20], "graph_id string, src long, dst long").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema("graph_id string, src long, dst long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seeds = spark.createDataFrame([("g", 0)], "graph_id string, node_id long")
    query = keep_reachable(stream, str(tmp_path / "state"), seeds, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = {r["node_id"] for r in spark.read.parquet(str(tmp_path / "state/reached")).collect()}
    want, todo = set(), [0]
    while todo:
        x = todo.pop()
        if x not in want:
            want.add(x)
            todo += [b for _, a, b in edges if a == x]
    assert got == want
