"""Similarity join of documents on word shingles by token-combination prefixes.

Documents are sets of hashed 5-word shingles; two link at a Jaccard similarity of
0.8 or more. Every step works on classes of equal sets, so copies cost nothing.

1. Tokens that no other class has come first in the global order. A class that
   has more than a fifth of its tokens to itself cannot link; counting a fixed
   share of the hash range (``COUNTED``) proves that for most classes.
2. For the others the tokens are counted. The ``MAX_FREQUENT`` most frequent
   ones, with at least ``FREQUENT`` classes each, form the frequent token
   classes; the order is: rare tokens by hash, then frequent ones by count.
3. A prefix is extended until its weight exceeds a fifth of the set: a rare token
   weighs one and is indexed alone; frequent tokens are dealt over m groups and
   each pair of one group is indexed, so p tokens of a group weigh p - 1. m
   follows the size of the set, so a class indexes a bounded multiple of its
   prefix. If two sets link, at most a fifth of the shorter-reaching prefix is
   unshared, so a single or a pair remains that both index.
4. Classes that share an index entry are candidates; of entries with the same
   classes one is kept. Task groups of bounded size compare sizes and parity
   sketches, which bound the symmetric difference from below. As only components
   are asked for, each group first names a spanning forest of its candidates,
   closest pairs first; these are decided on the whole sets, and components found
   are merged. Then every candidate pair of different components is named and
   decided.

Words are what the six ASCII separators part; A-Z are lower-cased. Hashes have 64
bits, and equal hashes count as equal shingles.

Defined results for odd input: null, empty and wordless texts have no shingles
and link with nothing, each being its own component; a null doc_id takes part but
never names a component (its component is null if no other id is in it); rows
with the same doc_id are separate documents of that id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcstep.llm.common import bit_filter, checkpoint, connected_components, free_name, give_back_memory, in_filter, map_batches, may_be_among, next_power_of_two, table, written
from arcstep.llm.shingles import mix, shingle_sets

#: Share of the hash range whose tokens are counted in step 1.
COUNTED = 0.3
#: Classes that have a token, from which on it may be frequent.
FREQUENT = 16
#: Frequent tokens at most; the list is sent to the tasks and takes eight bytes each.
MAX_FREQUENT = 1 << 18
#: A parity sketch has two bits for each token of the set, rounded up to a power of two, and at least this many.
SKETCH_BITS = 1 << 8
#: Classes on either side of a block of candidates; an entry with more is cut into several.
BLOCK = 1 << 12
#: Index rows that one group of small entries holds at most, or little more.
GROUP_ROWS = 1 << 13
#: Similarity of a link, as a fraction.
SIMILAR = (80, 100)

_KEY = "doc_id long, t long, n long, c long"


def _class_of(tokens: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n (set size) and c (the set's name; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = [], []
            for s in shingle_sets(batch.column(2).to_pylist()):
                sizes.append(len(s))
                names.append(_class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "t", "n", "c"])

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")), run, _KEY)


def _counted_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) for the tokens in the counted share of the hash range."""
    top = np.uint64(int(COUNTED * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                tokens, names = [], []
                for s in shingle_sets(texts[at : at + 512]):
                    few = s[: np.searchsorted(s, top)]
                    if len(few):
                        tokens.append(few)
                        names.append(np.full(len(few), _class_of(s), dtype=np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(names))], ["token", "c"]
                    )

    return map_batches(_texts(docs), run, "token long, c long")


def candidates_left(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, doc_id) of the classes that step 1 cannot rule out, doc_id being one document of each."""
    classes = sets.where("n > 1").groupBy("c", "n").agg(F.min("doc_id").alias("doc_id"))
    own = (
        _counted_tokens(docs)
        .groupBy("token")
        .agg(F.min("c").alias("c"), F.max("c").alias("last"))
        .where("c = last")
        .groupBy("c")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    return classes.join(own, "c", "left").where("own is null or 5 * own <= n").select("c", "doc_id")


def token_sets(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(c, n, tokens) of the classes left, tokens sorted as unsigned numbers.

    A document that the filter lets through although it is not wanted, or a
    second one of a class, adds rows that change no result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(left.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            wanted = in_filter(bits, batch.column(0).to_numpy(zero_copy_only=False))
            # A class may have null ids only.
            wanted |= batch.column(1).is_null().to_numpy(zero_copy_only=False)
            texts = batch.column(2).filter(pa.array(wanted)).to_pylist()
            for at in range(0, len(texts), 512):
                found = [s for s in shingle_sets(texts[at : at + 512]) if len(s) > 1]
                sizes = [len(s) for s in found]
                offsets = np.cumsum([0, *sizes]).astype(np.int32)
                values = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_class_of(s) for s in found], pa.int64()), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    ["c", "n", "tokens"],
                )

    return map_batches(_texts(docs).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text"), run, "c long, n long, tokens array<long>")


def frequent_tokens(sets: DataFrame) -> np.ndarray:
    """The frequent tokens, least frequent first: the bounded head of the exact counts."""
    head = (
        sets.select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= FREQUENT)
        .orderBy(F.desc("df"), "token")
        .limit(MAX_FREQUENT)
    )
    return head.toArrow().column("token").to_numpy()[::-1].copy().view(np.uint64)


def size_class(n: int) -> int:
    """Sizes of two sets that link are in the same or in neighbouring size classes."""
    return int(math.floor(math.log(n) / math.log(1.25) + 1e-9))


def groups_of(key: int) -> int:
    """Groups over which frequent tokens are dealt under a size key."""
    return max(1, int(1.25**key / 40))


def index_entries(tokens: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The index entries of a set: its prefix's rare tokens, and pairs of frequent tokens.

    ``frequent`` is sorted and ``order`` has the place of each by count.
    """
    n = len(tokens)
    need = n // 5 + 1
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    known = frequent[at] == tokens if len(frequent) else np.zeros(n, dtype=bool)
    rare = tokens[~known][:need]
    if len(rare) == need:
        return mix(rare)
    common = tokens[known][np.argsort(order[at[known]], kind="stable")]
    out = [mix(rare)]
    s = size_class(n)
    for key in (s, s + 1):
        m = groups_of(key)
        group = (mix(common ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
        weight = len(rare)
        members: dict[int, list[int]] = {}
        pairs: list[tuple[int, int]] = []
        for k, g in enumerate(group.tolist()):
            if weight >= need:
                break
            earlier = members.setdefault(g, [])
            weight += bool(earlier)
            pairs.extend((j, k) for j in earlier)
            earlier.append(k)
        if pairs:
            a, b = common[[j for j, _ in pairs]], common[[k for _, k in pairs]]
            out.append(mix(mix(np.minimum(a, b)) + np.maximum(a, b) * np.uint64(2 * key + 3)))
    return np.unique(np.concatenate(out))


def index_rows(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(entry, c, n) for the entries that two classes or more have."""
    order = np.arange(len(frequent))
    by_value = np.argsort(frequent, kind="stable")
    sent = sets.sparkSession.sparkContext.broadcast((frequent[by_value], order[by_value]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = sent.value
        for batch in batches:
            values = batch.column(2).values.to_numpy().view(np.uint64)
            cuts = batch.column(2).offsets.to_numpy()
            found = [index_entries(values[a:b], known, places) for a, b in zip(cuts[:-1], cuts[1:])]
            lengths = [len(x) for x in found]
            entries = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries), pa.array(np.repeat(batch.column(0).to_numpy(), lengths)), pa.array(np.repeat(batch.column(1).to_numpy(), lengths))],
                ["entry", "c", "n"],
            )

    rows = map_batches(sets.select("c", "n", "tokens"), run, "entry long, c long, n long")
    # Entries with the same classes are told by count, sum and parity of the classes' hashes.
    shape = rows.groupBy("entry").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(F.shiftright(F.xxhash64("c", F.lit(1)), 24)).alias("s"),
        F.bit_xor(F.xxhash64("c", F.lit(2))).alias("x"),
    )
    chosen = shape.where("k > 1").groupBy("k", "s", "x").agg(F.min("entry").alias("entry")).select("entry", "k")
    return rows.join(chosen, "entry")


def sketch_size(n: int) -> int:
    """Bits of the sketch of a set of n tokens."""
    return max(SKETCH_BITS, 2 * next_power_of_two(n))


def sketches(sets: DataFrame) -> DataFrame:
    """(c, sketch): for each place whether an odd number of the set's tokens fall there; the low bits of a token give its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, cuts = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            odd = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                size = sketch_size(int(b - a))
                odd.append(np.packbits(np.bincount(values[a:b] & (size - 1), minlength=size) & 1, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.binary())], ["c", "sketch"])

    return map_batches(sets.select("c", "tokens"), run, "c long, sketch binary").dropDuplicates(["c"])


def _differing(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Places in which sketches differ, rows by columns; a longer sketch is folded to the shorter one's length.

    Where lengths differ by more than a factor of two the sizes cannot fit, and 0 is returned.
    """
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    lx, ly = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    for size in np.unique(np.concatenate((lx, ly))):
        for i, j in (((lx == size), (ly == size)), ((lx == size), (ly == 2 * size)), ((lx == 2 * size), (ly == size))):
            i, j = np.flatnonzero(i), np.flatnonzero(j)
            if not len(i) or not len(j):
                continue
            fold = lambda v: v if len(v) == size else v[:size] ^ v[size:]  # noqa: B023, E731
            a, b = np.array([fold(x[k]) for k in i]), np.array([fold(y[k]) for k in j])
            differ = np.zeros((len(i), len(j)), dtype=np.int64)
            for k in range(size):
                differ += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None])
            out[np.ix_(i, j)] = differ
    return out


def _bits(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint64) for v in column.to_pylist()]


def may_link(n: np.ndarray, m: np.ndarray, sketch: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Pairwise (rows by columns): sizes fit, and the sketches allow a link.

    Sets of sizes n and m that link differ in at most (n + m)(1 - t)/(1 + t) tokens.
    """
    return _compared(n, m, sketch, other)[0]


def _compared(n: np.ndarray, m: np.ndarray, sketch: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``may_link`` and the share of tokens that differ at least."""
    low, high = np.minimum(n[:, None], m[None]), np.maximum(n[:, None], m[None])
    fits = SIMILAR[1] * low >= SIMILAR[0] * high
    differ = _differing(sketch, other)
    return fits & (differ * (SIMILAR[1] + SIMILAR[0]) <= (low + high) * (SIMILAR[1] - SIMILAR[0])), differ / (low + high)


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            (av, ao), (bv, bo) = (
                (batch.column(k).values.to_numpy(), batch.column(k).offsets.to_numpy()) for k in (2, 3)
            )
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(SIMILAR[1] * shared >= SIMILAR[0] * (len(x) + len(y) - shared))
            rows = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(rows), batch.column(1).filter(rows)], ["a", "b"])

    side = lambda c, t: sets.select(F.col("c").alias(c), F.col("tokens").alias(t))
    both = pairs.join(side("b", "tb"), "b").join(side("a", "ta"), "a").select("a", "b", "ta", "tb")
    return map_batches(both, run, "a long, b long")


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges (u, v), given closest first, make up a minimal spanning forest."""
    size = int(max(u.max(), v.max())) + 1 if len(u) else 0
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at, chosen = np.arange(len(u)), []
    while len(at):
        label = np.array([find(x) for x in range(size)])
        at = at[label[u[at]] != label[v[at]]]
        best = np.full(size, len(u))
        np.minimum.at(best, label[u[at]], at)
        np.minimum.at(best, label[v[at]], at)
        picked = np.unique(best[best < len(u)])
        for e in picked.tolist():
            a, b = find(int(u[e])), find(int(v[e]))
            root[max(a, b)] = min(a, b)
        chosen.append(picked)
    return np.concatenate(chosen) if chosen else at


def _sweeper(forest: bool) -> Callable[[pa.Table], pa.Table]:
    """Candidate pairs of different components inside the entries of one task group, all or a forest."""

    def run(group: pa.Table) -> pa.Table:
        get = lambda name: group.column(name).to_numpy()
        entry, c, n, comp, own = (get(x) for x in ("entry", "c", "n", "comp", "own"))
        i0, j0 = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        bits = _bits(group.column("sketch"))
        order = np.argsort(entry, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(entry[order]) != 0, [True])))
        _, name = np.unique(c, return_inverse=True)
        one = np.zeros(name.max() + 1, dtype=np.int64)  # a row of each class
        one[name] = np.arange(len(c))
        pairs, shares = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            x, y = (rows, rows) if i0 == j0 else (rows[own[rows] == i0], rows[own[rows] == j0])
            other = [bits[k] for k in y]
            for at in range(0, len(x), 512):
                part = x[at : at + 512]
                ok = comp[part][:, None] != comp[y][None]
                if ok.any():
                    may, share = _compared(n[part], n[y], [bits[k] for k in part], other)
                    p, q = np.nonzero(ok & may)
                    low, high = np.minimum(name[part[p]], name[y[q]]), np.maximum(name[part[p]], name[y[q]])
                    code, first = np.unique(low * len(one) + high, return_index=True)
                    pairs.append(code)
                    shares.append(share[p, q][first])
        found, first = np.unique(np.concatenate(pairs), return_index=True)
        p, q = found // len(one), found % len(one)
        if forest and len(found):
            closest = np.argsort(np.concatenate(shares)[first], kind="stable")
            p, q = p[closest], q[closest]
            kept = _forest(p, q)
            p, q = p[kept], q[kept]
        p, q = one[p], one[q]
        swap = c[p] > c[q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        if len(c) > GROUP_ROWS // 8:
            give_back_memory()
        return pa.table({"a": c[p], "b": c[q], "ca": comp[p], "cb": comp[q]})

    return run


def swept_pairs(known: DataFrame, marks: DataFrame, forest: bool) -> DataFrame:
    """(a, b, ca, cb): pairs of classes of different components that share an entry and may link.

    ``known`` has entry, c, n and comp. Entries led by the same least class mostly
    hold the same classes, so they are put into one task group, which names a pair
    once; groups are cut where they would hold more than GROUP_ROWS. An entry of
    more than BLOCK classes is cut into blocks, each pair of which is a group.
    """
    mixed = known.groupBy("entry").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("c").alias("lead"), F.count(F.lit(1)).alias("k")
    ).where("lo <> hi").select("entry", "lead", "k")
    mixed = checkpoint(mixed)
    led = mixed.groupBy("lead").agg(F.sum("k").alias("rows"))
    total = mixed.agg(F.sum("k")).first()[0] or 0
    parts = F.ceil(F.col("rows") / GROUP_ROWS)
    small = F.pmod(F.xxhash64("lead"), F.lit(8 * total // GROUP_ROWS + 1))
    placed = mixed.join(led, "lead").select(
        "entry",
        F.ceil(F.col("k") / BLOCK).cast("int").alias("nb"),
        F.when(F.col("rows") > GROUP_ROWS, F.col("lead")).otherwise(small).alias("bucket"),
        F.pmod(F.xxhash64("entry"), parts).cast("int").alias("part"),
    )
    dealt = (
        known.join(placed, "entry")
        .join(marks, "c")
        .withColumn("own", F.expr("cast(pmod(xxhash64(c, 5), nb) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("bucket", F.when(F.col("nb") > 1, F.col("entry")).otherwise(F.col("bucket")))
    )
    out = dealt.select("bucket", "part", "i", "j", "entry", "own", "c", "n", "comp", "sketch").groupBy("bucket", "part", "i", "j").applyInArrow(_sweeper(forest), "a long, b long, ca long, cb long")
    return out.distinct()


def components(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, comp) for the classes in the index; others are their own component."""
    marks = checkpoint(sketches(sets))
    tested = checkpoint(swept_pairs(rows.withColumn("comp", F.col("c")), marks, forest=True).select("a", "b"))
    merged = connected_components(linked_pairs(tested, sets)).select(F.col("node").alias("c"), F.col("component_id").alias("comp"))
    known = checkpoint(rows.join(merged, "c", "left").withColumn("comp", F.coalesce("comp", "c")))
    pairs = checkpoint(swept_pairs(known, marks, forest=False).join(tested, ["a", "b"], "left_anti"))
    more = linked_pairs(pairs.select("a", "b"), sets).join(pairs, ["a", "b"]).select("ca", "cb")
    joined = connected_components(more, "ca", "cb").select(F.col("node").alias("comp"), F.col("component_id").alias("new"))
    labels = known.select("c", "comp").distinct()
    return labels.join(joined, "comp", "left").select("c", F.coalesce("new", "comp").alias("comp"))


def labelled_documents(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n, comp (the component's name) and component_id of every document."""
    sets = checkpoint(document_sets(docs))
    left = checkpoint(candidates_left(docs, sets))
    tokens = checkpoint(token_sets(docs, left))
    rows = checkpoint(index_rows(tokens, frequent_tokens(tokens)))
    labels = components(rows, tokens)
    classes = sets.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = written(classes.join(labels, "c", "left").select("c", "least", F.coalesce("comp", "c").alias("comp")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "comp").select("c", "comp", "component_id")
    return sets.join(by_class, "c", "left").select(
        "doc_id", "t", "n", "comp", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return labelled_documents(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _has_order(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_has_order(x.dataType) for x in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the least doc_id, nulls last, then the least hash of the text.

    Rows are told apart by doc_id and text; of those with both equal, one that is
    least in the other columns stays; columns that have no order, such as maps, do not
    count there. Documents without a shingle all stay.
    """
    rows = labelled_documents(docs).where("comp is not null").select("comp", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t").alias("key"))
    keys = checkpoint(rows.groupBy("comp", "key").agg(F.count(F.lit(1)).alias("n")))
    first = keys.groupBy("comp").agg(F.min("key").alias("first"))
    judged = keys.join(first, "comp").select("key.doc_id", "key.t", (F.col("key") == F.col("first")).alias("stays"), "n").where("not stays or n > 1")
    d, t, h, stays = (free_name(x, docs.columns) for x in ("d", "t", "h", "stays"))
    found = written(judged.select(F.col("doc_id").alias(d), F.col("t").alias(t), F.col("stays").alias(stays), F.xxhash64("doc_id", "t").alias(h)))
    own = docs.withColumns({d: F.col("doc_id").cast("long"), t: F.xxhash64(F.col("text").cast("string"))})
    marked = own.withColumn(h, may_be_among(docs.sparkSession, found.select(h), F.xxhash64(d, t)))
    rest = marked.where(~F.col(h)).drop(d, t, h)
    named = found.drop(h)
    same = marked[d].eqNullSafe(named[d]) & (marked[t] == named[t])
    touched = marked.where(h).join(named, same, "left").drop(named[d], named[t])
    once = touched.where(F.col(stays).isNull()).drop(d, t, h, stays)
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    order = F.struct(F.lit(0), *[F.col(f"row.`{x.name}`") for x in docs.schema if _has_order(x.dataType)])
    several = touched.where(stays).select(d, t, row).groupBy(d, t).agg(F.min_by("row", order).alias("row")).select("row.*")
    return rest.unionByName(once).unionByName(several)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = w.doc_id"""
    }


def queries() -> dict:
    return {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
