"""Embedding near-duplicates by product quantisation.

Vectors are put into coarse inverted lists; a vector's residual to its list's
centroid is stored as one code for each subspace. Every vector looks up the
lists near it: in a list, table lookups give its distance to the coded members,
less the members' known quantisation error a true lower bound, so no pair of the
list is lost; the pairs left are compared by exact cosine in double precision.

Which lists are probed: a vector within the link distance d of x lies on the far
side of the plane between x's centroid and another one only if it moved towards
it by x's distance from that plane. A list is probed when that distance is at
most ``PROBE_WIDTH * d / sqrt(dimensions)``, that many standard deviations of a
move of length d in a random direction. A pair is found if either vector probes
the other's list.

Cost of dense groups: equal vectors are one row with a weight. Members of a list
within half the link angle of its centroid all link with one another, so they
are counted, not compared. What remains is compared in blocks of bounded size.

The quantiser is fitted on a bounded sample, the ``FIT_ROWS`` vectors with the
smallest hash; every vector is indexed. Recall is measured against brute force in
the tests.

Defined results for odd input: vectors that are null, zero, of another length
than the first vector fitted, or hold null or non-finite components link with
nothing and are their own component; a null vec_id takes part but never names a
component; repeated rows link with each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import checkpoint, connected_components, map_batches, next_power_of_two, ship_package, table

#: Cosine of a link.
COSINE = 0.95
#: Vectors the quantiser is fitted on.
FIT_ROWS = 16_384
#: Vectors for each list, and lists at most: the centroids are sent to every task.
LIST_ROWS, MAX_LISTS = 128, 4_096
#: Subspaces and codes in each.
SUBSPACES, CODES = 8, 64
#: Standard deviations of a random move that the probes cover.
PROBE_WIDTH = 3.5
#: Vectors on either side of a block that is compared at once.
BLOCK = 1_024


@dataclass
class Quantiser:
    """Unit centroids, and a codebook of residuals for each subspace."""

    centroids: np.ndarray
    codebooks: np.ndarray  # (subspaces, codes, dimensions of a subspace)
    cosine: float

    @property
    def distance(self) -> float:
        """Euclidean distance of two unit vectors that just link."""
        return float(np.sqrt(2 - 2 * self.cosine))

    def split(self, residuals: np.ndarray) -> np.ndarray:
        s, _, d = self.codebooks.shape
        padded = np.zeros((len(residuals), s * d))
        padded[:, : residuals.shape[1]] = residuals
        return padded.reshape(len(residuals), s, d)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each residual and what its codes stand for."""
        parts = self.split(residuals)
        codes = np.empty(parts.shape[:2], dtype=np.uint8)
        error = np.zeros(len(parts))
        for s in range(parts.shape[1]):
            d = _squares(parts[:, s], self.codebooks[s])
            codes[:, s] = d.argmin(axis=1)
            error += d[np.arange(len(parts)), codes[:, s]]
        return codes, np.sqrt(np.maximum(error, 0))

    def lookup(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals to coded members, by table lookup."""
        parts = self.split(residuals)
        total = np.zeros((len(parts), len(codes)))
        for s in range(parts.shape[1]):
            total += np.take(_squares(parts[:, s], self.codebooks[s]), codes[:, s], axis=1)
        return np.sqrt(np.maximum(total, 0))

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each vector, and which lists it probes (boolean)."""
        near = unit @ self.centroids.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(unit)), home]
        apart = np.sqrt(np.maximum(2 - 2 * self.centroids @ self.centroids.T, 1e-12))
        # Unit centroids: the plane between two is at (best - near) / apart from the vector.
        depth = (best[:, None] - near) / apart[home]
        wide = PROBE_WIDTH * self.distance / np.sqrt(unit.shape[1])
        depth[np.arange(len(unit)), home] = 0
        return home, depth <= wide


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _means(rows: np.ndarray, k: int, unit: bool, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; with ``unit`` on the sphere."""
    centers = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        owner = (rows @ centers.T).argmax(1) if unit else _squares(rows, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, rows)
        count = np.bincount(owner, minlength=len(centers))
        live = count > 0
        centers[live] = sums[live] / count[live, None]
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def fit(sample: np.ndarray, total: int, cosine: float = COSINE) -> Quantiser:
    """Fits the lists and codebooks on unit vectors; ``total`` is the number of all vectors."""
    k = min(MAX_LISTS, max(1, next_power_of_two(max(1, total // LIST_ROWS))), max(1, len(sample) // 8))
    centers = _means(sample, k, unit=True)
    # A dense group must not be spread over many lists: of close centroids the one with most rows stays.
    owner = (sample @ centers.T).argmax(1)
    order = np.argsort(-np.bincount(owner, minlength=len(centers)), kind="stable")
    kept: list[int] = []
    for c in order:
        if not kept or (centers[kept] @ centers[c]).max() < cosine:
            kept.append(int(c))
    centers = centers[kept]
    owner = (sample @ centers.T).argmax(1)
    sums = np.zeros_like(centers)
    np.add.at(sums, owner, sample)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    centers = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
    residuals = sample - centers[(sample @ centers.T).argmax(1)]
    width = -(-sample.shape[1] // SUBSPACES)
    padded = np.zeros((len(sample), SUBSPACES * width))
    padded[:, : sample.shape[1]] = residuals
    books = np.zeros((SUBSPACES, CODES, width))
    for s in range(SUBSPACES):
        own = _means(padded[:, s * width : (s + 1) * width], CODES, unit=False)
        books[s, : len(own)] = own
        books[s, len(own) :] = own[0]
    return Quantiser(centers, books, cosine)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.float64)


def _doubles() -> Column:
    """The vector in double precision, without negative zeros, so that equal vectors have equal hashes."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(v, id, w): the distinct usable vectors as arrays of doubles, a member's id each, and their rows."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _doubles().alias("v")).where(
        "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    return usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w")).withColumn("c", F.xxhash64("v"))


def assigned(classes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Adds home, inner (whether within half the link angle of the centroid), codes, error and probes."""
    size = quantiser.centroids.shape[1]
    sent = classes.sparkSession.sparkContext.broadcast(quantiser)
    half = float(np.sqrt((1 + quantiser.cosine) / 2)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), size)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                home, probed = q.probes(unit)
                codes, error = q.encode(unit - q.centroids[home])
                inner = (unit * q.centroids[home]).sum(1) >= half
                rows, lists = np.nonzero(probed)
                offsets = np.searchsorted(rows, np.arange(len(x) + 1))
                probes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, pa.array(home, pa.int32()), pa.array(inner),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes,
                    ],
                    ["c", "v", "w", "home", "inner", "codes", "error", "probes"],
                )

    return map_batches(
        classes.where(F.size("v") == size).select("c", "v", "w"), run,
        "c long, v array<double>, w long, home int, inner boolean, codes binary, error double, probes array<int>",
    )


def _compare(quantiser: Quantiser, rows: pa.Table) -> pa.Table:
    """One block: probing vectors against members of one list. Returns weights of links, and forest edges."""
    empty = pa.table({"c": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    member = rows.column("member").to_numpy(zero_copy_only=False).astype(bool)
    m, p = rows.filter(pa.array(member)).combine_chunks(), rows.filter(pa.array(~member)).combine_chunks()
    if not m.num_rows or not p.num_rows:
        return empty
    size = quantiser.centroids.shape[1]
    get = lambda t, name: t.column(name).combine_chunks()
    x, y = _matrix(get(p, "v"), size), _matrix(get(m, "v"), size)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    here = rows.column("list")[0].as_py()
    codes = np.frombuffer(b"".join(get(m, "codes").to_pylist()), dtype=np.uint8).reshape(m.num_rows, -1)
    far = quantiser.lookup(x / nx[:, None] - quantiser.centroids[here], codes)
    i, j = np.nonzero(far <= quantiser.distance + 1e-6 + get(m, "error").to_numpy()[None])
    cp, cm = get(p, "c").to_numpy(), get(m, "c").to_numpy()
    other = cp[i] != cm[j]
    i, j = i[other], j[other]
    linked = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        linked[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= quantiser.cosine
    i, j = i[linked], j[linked]
    if not len(i):
        return empty
    wp, wm = get(p, "w").to_numpy(), get(m, "w").to_numpy()
    # If the member also probes the other's list, the pair turns up there with the sides changed.
    homes = get(p, "home").to_numpy()[i]
    offsets = get(m, "probes").offsets.to_numpy()
    values = get(m, "probes").values.to_numpy()
    known = {(k, int(v)) for k in np.unique(j).tolist() for v in values[offsets[k] : offsets[k + 1]]}
    back = np.array([h == here or (k, h) in known for k, h in zip(j.tolist(), homes.tolist(), strict=True)], dtype=bool)
    links_p, links_m = np.zeros(len(cp), dtype=np.int64), np.zeros(len(cm), dtype=np.int64)
    np.add.at(links_p, i, wm[j])
    np.add.at(links_m, j[~back], wp[i[~back]])
    # Least name reachable inside the block: a forest over the linked vectors.
    lp, lm = cp.copy(), cm.copy()
    while True:
        least = np.minimum(lp[i], lm[j])
        op, om = lp.copy(), lm.copy()
        np.minimum.at(lp, i, least)
        np.minimum.at(lm, j, least)
        if (op == lp).all() and (om == lm).all():
            break
    a, b = np.unique(i), np.unique(j)
    return pa.table(
        {
            "c": pa.array(np.concatenate((cp[a], cm[b]))),
            "other": pa.array(np.concatenate((lp[a], lm[b]))),
            "n": pa.array(np.concatenate((links_p[a], links_m[b]))),
        }
    )


def block_links(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(c, other, n): for each block a vector's weight of links there, and a vector of its component."""
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(quantiser)
    members = rows.select("c", "v", "w", "home", F.col("home").alias("list"), F.col("inner").cast("int").alias("kind"), "codes", "error", "probes", F.lit(True).alias("member"))
    # Inner members of a list link with each other anyway, so an inner vector looks only for the others at home.
    looks = rows.select("c", "v", "w", "home", "inner", F.explode("probes").alias("list")).select(
        "*", F.explode(F.expr("case when inner and list = home then array(0) else array(0, 1) end")).alias("kind")
    )
    looks = looks.select("c", "v", "w", "home", "list", "kind", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes"), F.lit(False).alias("member"))
    sizes = members.groupBy("list", "kind").agg(F.count(F.lit(1)).alias("m")).join(
        looks.groupBy("list", "kind").agg(F.count(F.lit(1)).alias("p")), ["list", "kind"]
    )
    blocks = {  # two numbers for each of the lists, of which there are at most MAX_LISTS
        (r["list"], r["kind"]): (-(-r["m"] // BLOCK), -(-r["p"] // BLOCK)) for r in sizes.collect()
    }
    if not blocks:
        return spark.createDataFrame([], "c long, other long, n long")
    cut = spark.createDataFrame([(a, k, m, p) for (a, k), (m, p) in blocks.items()], "list int, kind int, nm int, np int")
    dealt = members.unionByName(looks).join(F.broadcast(cut), ["list", "kind"])
    own = F.expr("cast(pmod(xxhash64(c, 7), case when member then nm else np end) as int)")
    dealt = dealt.withColumn("own", own).withColumn(
        "opposite", F.explode(F.expr("sequence(0, case when member then np else nm end - 1)"))
    )
    dealt = dealt.withColumn("mb", F.expr("case when member then own else opposite end")).withColumn(
        "pb", F.expr("case when member then opposite else own end")
    )

    def run(group: pa.Table) -> pa.Table:
        return _compare(sent.value, group)

    return dealt.drop("nm", "np", "own", "opposite").groupBy("list", "kind", "mb", "pb").applyInArrow(run, "c long, other long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    classes = checkpoint(vector_classes(vectors))
    total = classes.count()
    head = classes.select("c", "v").orderBy("c").limit(FIT_ROWS).collect()
    if total:
        lengths = [len(r["v"]) for r in head]
        size = max(set(lengths), key=lambda n: (lengths.count(n), n))
        sample = np.array([r["v"] for r in head if len(r["v"]) == size], dtype=np.float64)
        quantiser = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), total, cosine)
        rows = checkpoint(assigned(classes, quantiser))
        inner = rows.where("inner").groupBy("home").agg(F.sum("w").alias("all"), F.min("c").alias("other"))
        counted = rows.where("inner").join(inner, "home").select("c", "other", (F.col("all") - F.col("w")).alias("n"))
        links = checkpoint(block_links(rows, quantiser).unionByName(counted))
    else:
        links = spark.createDataFrame([], "c long, other long, n long")
    degree = links.groupBy("c").agg(F.sum("n").alias("n"))
    comps = connected_components(links, "c", "other")
    named = classes.select("c", "least", "w").join(degree, "c", "left").join(comps.withColumnRenamed("node", "c"), "c", "left")
    named = named.withColumn("comp", F.coalesce("component_id", "c")).drop("component_id")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "comp").select(
        F.col("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"
    )
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(_doubles()).alias("c"))
    out = ids.join(by_class, "c", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) ON node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = e.vec_id"""
    }


def queries() -> dict:
    return {"op2_embedding_dedup": op2_embedding_dedup}
