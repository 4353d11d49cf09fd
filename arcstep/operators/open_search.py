"""Searches of graphs that are not stored: successors come from a function over the frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcstep.operators.frames import COMPACT, checkpoint, dense_ids, discard

STATE = ["graph_id", "key"]


class Exhausted(RuntimeError):
    """More states were found than the search may hold."""


def open_search(
    seeds: DataFrame,
    successors: Callable[[DataFrame], DataFrame],
    max_states: int | None = None,
    max_depth: int | None = None,
    skip: Column | str | None = None,
) -> DataFrame:
    """(graph_id, key, node_id, depth, parent) of every state that the seeds reach.

    ``successors`` maps new states (graph_id, key, depth) to (graph_id, key, next) rows; it is
    called once a level and sees every state once. Keys that were not seen before are
    numbered, level by level in the order of the keys; ``parent`` is the least key of the level
    before that leads to one. States that satisfy ``skip`` are found, not expanded.
    Raises ``Exhausted`` as soon as more than ``max_states`` are known.
    """
    null = F.lit(None).cast(seeds.schema["key"].dataType)
    frontier = checkpoint(seeds.select(*STATE).distinct().select(*STATE, F.lit(0).cast("long").alias("depth"), null.alias("parent")))
    known, parts, depth, total = frontier, [frontier], 0, frontier.count()
    while True:
        if max_states is not None and total > max_states:
            raise Exhausted(f"more than {max_states} states at depth {depth}")
        if max_depth is not None and depth >= max_depth:
            break
        depth += 1
        open_ = frontier if skip is None else frontier.where(~F.expr(skip) if isinstance(skip, str) else ~skip)
        found = successors(open_.select(*STATE, "depth")).select("graph_id", F.col("next").alias("key"), F.col("key").alias("from"))
        found = found.where("key is not null").groupBy(*STATE).agg(F.min("from").alias("parent")).join(known.select(*STATE), STATE, "left_anti")
        frontier = checkpoint(found.select(*STATE, F.lit(depth).cast("long").alias("depth"), "parent"))
        new = frontier.count()
        if not new:
            break
        total += new
        known = known.unionByName(frontier)
        parts.append(frontier)
        if len(parts) > COMPACT:
            known = checkpoint(known)
            discard(*parts[:-1])
            parts = [known]
    return dense_ids(known, ["depth", "key"], "node_id", ["graph_id"]).select(*STATE, "node_id", "depth", "parent")
