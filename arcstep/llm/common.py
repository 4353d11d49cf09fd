"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of a word: a word is a maximal run of other characters.
WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What one Arrow batch between the JVM and a Python worker holds at most, unless the session says less.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and bound the batches they get.

    Spark's own file server distributes the archive; the driver's temporary
    folder is only read by the driver. Texts vary in length without bound, so
    batches are cut by bytes: the session's limits are lowered to ``BATCH_ROWS``
    and ``BATCH_BYTES``.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = (spark.conf.get(key) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if getattr(context, "_arcstep_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="arcstep-"), "arcstep_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("arcstep", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._arcstep_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only where none is set and the master is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="arcstep-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the frames that ``written`` returned.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, read again.

    Unlike a checkpoint, which keeps the optimizer's old estimate, what is read
    has its real size, so that loops neither blow the estimate up nor lose
    broadcast joins.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the files of a job's shuffles are deleted as soon as the job has ended, where the session knows how to."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if before is not None:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame of ``written`` that nothing reads any more."""
    folder = _FOLDERS.pop(df, None)
    if folder is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(base: str, taken: Iterable[str]) -> str:
    """``base``, or ``base`` with underscores, that is not among the names taken, whatever their case."""
    lower = {x.lower() for x in taken}
    while base.lower() in lower:
        base += "_"
    return base


#: Bits of the filter of ``marked_rows``; its size is fixed, and others that it lets through cost time only.
FILTER_BITS = 1 << 26


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bit set at pmod(h, FILTER_BITS) for every long h of the one column; at most FILTER_BITS / 64 rows are fetched."""
    name = hashes.columns[0]
    placed = hashes.select(F.pmod(name, F.lit(FILTER_BITS)).alias("place")).where("place is not null")
    found = placed.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes have their bit set."""
    places = hashes % FILTER_BITS
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) != 0


def may_be_among(spark: SparkSession, hashes: DataFrame, column: Column) -> Column:
    """True wherever the long ``column`` is among ``hashes``, and for a few others: spares most rows an exact join."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(bit_filter(hashes))

    def hit(values: pa.Array) -> pa.Array:
        return pa.array(in_filter(sent.value, values.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(hit, "boolean")(column)


def give_back_memory() -> None:
    """Returns what a worker has freed to the system, since the worker lives on and shares the executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` after making sure that the workers can import this package."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back_memory()

    return df.mapInArrow(run, schema)


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of an undirected edge list.

    Alternating large-star and small-star steps: every node is linked to the
    smallest node it knows, so the number of rounds grows with the logarithm of
    a component's size. A star's minimum is a partial aggregate joined back, so
    no neighbourhood is ever gathered in one task. Returns (node, component_id)
    for the nodes that have an edge; null ends and self edges are ignored.
    """
    links = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = written(links)
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u goes to u's smallest neighbour (or u itself).
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: u's smaller neighbours, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        last, links = links, written(small)
        discard(last)
        now = tuple(
            links.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))
