"""Written tables, rounds, components and ids shared by the graph operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds after which an iteration gives up.
MAX_ROUNDS = 10_000
#: Rounds after which the parts of a closure are written as one table.
COMPACT = 8
#: Steps that a round of a closure takes.
HOPS = 4

#: Bytes that the optimizer takes a byte of a table's files for. Key columns shrink to a byte or two a row in Parquet
#: and grow to over a hundred in a broadcast, which the driver builds; taken for their size in files, tables of
#: millions of rows are broadcast, many at once.
FILE_FACTOR = 100.0

#: Bytes of rows up to which a shuffled side of a join is broadcast after all, once its size is known. The driver builds
#: all of a plan's broadcasts at a time and needs several times their size; plans of jump tables have dozens of joins.
BROADCAST = 1 << 20

#: Rows from which on a table that many joins read is written in buckets of their keys.
LARGE = 500_000

#: Links of one node from which on its least neighbour is broadcast to them.
HOT = 100_000

#: Folders of the frames that ``checkpoint`` returned, and the tables over those that ``dealt`` wrote in buckets.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one is made only where none is set and the master is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="arcstep-graph-"))
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < FILE_FACTOR:
        spark.conf.set(factor, str(FILE_FACTOR))
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(adaptive, None) is None:
        spark.conf.set(adaptive, str(BROADCAST))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, which outlives executors, read again.

    This cuts the lineage as ``DataFrame.checkpoint`` does. That keeps the
    optimizer's old size estimate, which multiplies from round to round; what is
    read here has the size of its files (times ``FILE_FACTOR``), so small frontiers
    are broadcast, large tables are not, and plans stay cheap however many rounds there are.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing reads any more."""
    for df in frames:
        name = _TABLES.pop(df, None)
        if name is not None:
            df.sparkSession.sql(f"drop table if exists {name}")
        folder = _FOLDERS.pop(df, None)
        if folder is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, *keys: str) -> DataFrame:
    """A reliable checkpoint dealt by ``keys``: joins on them in every round of a loop leave it where it is."""
    spark = df.sparkSession
    shared_folder(spark)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint(eager=True)


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None = None, keep: bool = False) -> DataFrame:
    """``df`` as a written table; one of more than ``LARGE`` rows in buckets of ``keys``, which joins on exactly these need not move.

    ``rows`` is the number of rows, for a ``df`` that is a written table already; it is deleted unless ``keep`` is set.
    """
    if rows is None:
        df = checkpoint(df)
        rows = df.count()
    if rows <= LARGE:
        return df
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"arcstep_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).option("path", folder).saveAsTable(name)
    out = spark.table(name)
    _FOLDERS[out], _TABLES[out] = folder, name
    if not keep:
        discard(df)
    return out


def dense_ids(df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds 0-based gapless ids in the order of ``order``, which must be unique; counted for each ``within`` on its own.

    The rows are range-partitioned and numbered in their partition; only the
    partitions' counts meet in one place, so no task sees all rows, not even all
    of one group.
    """
    placed = checkpoint(df.orderBy(*within, *order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    # A group's rows are consecutive in every partition, so its first one there and its rows before that place them all.
    counts = placed.groupBy(*within, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = (W.partitionBy(*within) if within else W.partitionBy()).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*within, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__start"))
    joined = placed.join(starts, [*within, "__part"]) if within else placed.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__at", "__part", "__start")


def closure(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    max_rounds: int | None = None,
    best: dict[str, Column] | None = None,
    hops: int | None = None,
) -> DataFrame:
    """Semi-naive closure: ``step`` maps the last round's new rows to candidates.

    Candidates are reduced to one row a key (``best`` names the other columns'
    aggregates, such as minima) and those with a known key are dropped. All
    graphs advance together, one job a round. The rows known so far are
    compacted now and then, so that plans stay short.

    A round takes ``hops`` steps before it asks what is known, so that what the steps join
    is moved as much less often; what is found again within a
    round is stepped from again in it. One step is the default where there are
    ``best`` columns or a bound on rounds, else ``HOPS``. With ``best`` columns more
    are right only where a row's columns get no better by a longer way, as depths do.
    """
    names = list(keys)
    one = lambda df: df.groupBy(*names).agg(*[c.alias(k) for k, c in best.items()]) if best else df.select(*names).distinct()
    if hops is None:
        hops = 1 if best or max_rounds is not None else HOPS
    columns = [*names, *(best or {})]
    part = checkpoint(one(seed))
    # What is known: large parts in buckets of the keys, where new rows come to them, and recent ones, which are moved to these.
    placed, recent, recent_rows = [], [], 0
    rows = more = part.count()
    rounds = 0
    while True:
        if rows > LARGE:
            part = dealt(part, names, rows)
            placed.append(part)
            if len(placed) > COMPACT:
                whole = dealt(_union(placed[:-1], columns), names)
                discard(*placed[:-1])
                placed = [whole, part]
        else:
            recent.append(part)
            recent_rows += rows
            if len(recent) > COMPACT:
                whole, whole_rows = dealt(_union(recent[:-1], columns), names), recent_rows - rows
                discard(*recent[:-1])  # the last part is the frontier of the next round
                if whole_rows > LARGE:
                    placed, recent, recent_rows = [*placed, whole], [part], rows
                else:
                    recent = [whole, part]
        if not more or max_rounds is not None and rounds >= max_rounds:
            return _union(placed + recent, columns)
        frontier = part.where(F.col("__hop") == hops).drop("__hop") if rounds and hops > 1 else part
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
        ahead = found = one(step(frontier))
        if hops > 1:
            found = found.withColumn("__hop", F.lit(1))
            for hop in range(2, hops + 1):
                ahead = one(step(ahead))
                found = found.unionByName(ahead.withColumn("__hop", F.lit(hop)))
            found = found.groupBy(*names).agg(*[c.alias(k) for k, c in (best or {}).items()], F.min("__hop").alias("__hop"))
        for old in [*placed, *([_union(recent, names)] if recent else [])]:
            found = found.join(old.select(*names), names, "left_anti")
        part = checkpoint(found)
        # What the last step found first is not stepped from yet.
        rows, more = part.agg(F.count(F.lit(1)), F.count(F.when(F.col("__hop") == hops if hops > 1 else F.lit(True), 1))).first()


def _union(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def relax(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], label: str, hops: int = HOPS) -> DataFrame:
    """Least label of every key: rows whose label improves are expanded again.

    A round takes ``hops`` steps and then keeps what is less than the label known, as a part of its own; the
    parts are joined now and then, so that what is known is not written in every round.
    """
    names = list(keys)
    least = lambda parts: _union(parts, [*names, label]).groupBy(*names).agg(F.min(label).alias(label))
    known = dealt(least([seed]), names)
    recent: list[DataFrame] = []
    frontier = known
    for _ in range(MAX_ROUNDS):
        found, ahead = None, frontier.select(*names, label)
        for hop in range(1, hops + 1):
            ahead = step(ahead).groupBy(*names).agg(F.min(label).alias(label)).where(F.col(label).isNotNull())
            more = ahead.select(*names, F.struct(F.col(label).alias("new"), F.lit(hop).alias("hop")).alias("__new"))
            found = more if found is None else found.unionByName(more)
        found = found.groupBy(*names).agg(F.min("__new").alias("__new"))
        for k, old in enumerate([known, *([least(recent)] if recent else [])]):
            found = found.join(old.select(*names, F.col(label).alias(f"__old{k}"), F.lit(True).alias(f"__has{k}")), names, "left")
            found = found.where(F.col(f"__has{k}").isNull() | F.col(f"__old{k}").isNull() | (F.col("__new.new") < F.col(f"__old{k}"))).drop(f"__old{k}", f"__has{k}")
        part = checkpoint(found.select(*names, F.col("__new.new").alias(label), F.col("__new.hop").alias("__hop")))
        # A label that an earlier step of the round found has been expanded in it.
        rows, open_ = part.agg(F.count(F.lit(1)), F.count(F.when(F.col("__hop") == hops, 1))).first()
        if rows:
            recent.append(part)
        if not open_:
            return checkpoint(least([known, *recent])) if recent else known
        frontier = part.where(F.col("__hop") == hops)
        if len(recent) > COMPACT:
            old = [known, *recent]
            known, recent = dealt(least(old), names), []
            frontier = checkpoint(frontier)
            discard(*old)
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def star_components(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, node, component): the least node that undirected (keys, a, b) rows connect to each, for nodes with a row.

    Alternating large and small stars link every node to the least one it knows,
    so that rounds grow with the logarithm of a component's size. A star's least
    node is a partial aggregate joined back; the few of stars of more than ``HOT`` links are
    broadcast, so that no large neighbourhood meets in one task.
    """
    keys = list(keys)
    ends = pairs.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = checkpoint(ends.select(*keys, F.col("u").alias("node")).union(ends.select(*keys, "v")).distinct())
    links = checkpoint(ends.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = _with_least(large, least, [*keys, "u"])
        small = joined.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
        last, links = links, checkpoint(small.where("u <> v").distinct())
        discard(last)
        now = digest(links, [*keys, "u", "v"])
        if now == before:
            named = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.join(named, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
        before = now
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def _with_least(links: DataFrame, least: DataFrame, key: list[str]) -> DataFrame:
    """``links`` with ``m`` of their key in ``least``, which counts the links of a key as ``n``."""
    hot = least.where(F.col("n") > HOT).select(*key, F.col("m").alias("hot"))
    rows = links.join(F.broadcast(hot), key, "left")
    rest = rows.where("hot is null").drop("hot").join(least.where(F.col("n") <= HOT).select(*key, "m"), key)
    return rows.where("hot is not null").withColumnRenamed("hot", "m").unionByName(rest)


def digest(df: DataFrame, columns: Sequence[str]) -> tuple:
    """Row count and an order-free hash sum."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
