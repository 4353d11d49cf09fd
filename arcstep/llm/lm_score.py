"""Cross-entropy difference scores from matched n-gram models.

A target model is counted on chosen documents and a background model on all others,
over one shared vocabulary: every word and every bigram of the corpus, each a symbol
with a 64-bit hash, and a start mark. The background is matched to the target by
weight: its counts c are multiplied so that both models have N tokens, those of the
target. The loss of a token w after h under either model is

    MIX * -ln((c(w) + PRIOR) / (N + PRIOR * V)) + (1 - MIX) * -ln((c(h w) + PRIOR) / (c(h) + PRIOR * V)),

V being the vocabulary's words: the losses of a unigram and of a bigram model, each a
probability over the vocabulary (the bigram's rest is that a text ends after h). So
what a model has never seen costs about ln V, never less than what it has seen. A
document's score is its mean loss under the target model less that under the
background model: the lower, the more it is like the target. Losses are sums over
symbols, so a document is scored by one join of its distinct symbols with the table
of counts.

No document is scored by itself: its own counts are taken off its model first. Where ``train`` is given, the models
are counted on it alone and nothing is taken off.

What is gathered follows the corpus: the counts are a keyed table of Spark's. Only
two things of fixed size reach the driver and the tasks, and both only save work:
the counts of the ``MAX_HOT`` most frequent symbols, so that those never meet in a
join, and a filter of the symbols that occur twice or more, since others have no
count but a document's own. The texts are read once for the counts, once for the scores.

Words are what the six ASCII separators part, A-Z lower-cased. Defined results for
odd input: null, empty and wordless texts have no tokens and null losses; a null
doc_id is scored and never a target; rows with the same doc_id are scored each;
without targets all target counts are zero and the background keeps its own; an empty table gives no rows; other
columns are ignored; texts of any length are cut into blocks at no loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import bit_filter, in_filter, map_batches, may_be_among, shuffles_freed, table, written
from arcstep.llm.shingles import mix, word_blocks

#: Weight of the unigram loss in a token's loss.
MIX = 0.3
#: Pseudo-count of every word, also after every history.
PRIOR = 0.1
#: Most frequent symbols whose counts are sent to the tasks; they take 24 bytes each.
MAX_HOT = 1 << 18
#: Rows that a task holds before it passes them on.
MAX_HELD = 1 << 21

_START = np.uint64(0x5851F42D4C957F2C)


def symbols(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: the first text's place, the number of texts, their tokens, and of every distinct symbol of each text the text, the symbol, how often it occurs and how often as a history.

    Bigrams are odd numbers, words and the start mark even ones.
    """
    raws = [None if x is None else x.lower() for x in column.cast(pa.binary()).to_pylist()]
    one, even = np.uint64(1), ~np.uint64(1)
    for first, hashes, cuts, _ in word_blocks(raws):
        n, texts = len(hashes), len(cuts) - 1
        tokens = np.diff(cuts)
        text = np.repeat(np.arange(texts), tokens)
        word = hashes & even
        before = np.concatenate(([_START], word[:-1]))[:n]
        before[cuts[:-1][tokens > 0]] = _START
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ word) | one
        symbol, owner = np.concatenate((word, pair, before)), np.concatenate((text, text, text))
        own = np.concatenate((np.ones(2 * n, np.int64), (before == _START).astype(np.int64)))
        history = np.repeat(np.array([0, 1]), [2 * n, n])
        # Symbols of one text get one key.
        key = mix(symbol + (owner + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if n else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x[order], at) if n else x  # noqa: B023, E731
        rows = order[at]
        yield first, texts, tokens, owner[rows], symbol[rows].view(np.int64), add(own), add(history)


def _counted(texts: DataFrame) -> DataFrame:
    """(symbol, n, aim): occurrences of every symbol in all texts and in targets, counted inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            symbol, n, aim = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            at = np.flatnonzero(np.concatenate(([True], np.diff(symbol) != 0)))
            return pa.RecordBatch.from_arrays([pa.array(symbol[at]), *(pa.array(np.add.reduceat(x[order], at)) for x in (n, aim))], ["symbol", "n", "aim"])

        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, _, _, owner, symbol, own, _ in symbols(batch.column(0)):
                if len(symbol):
                    held.append((symbol, own, own * target[first + owner]))
                    size += len(symbol)
                if size >= MAX_HELD:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return map_batches(texts.select("text", "target"), run, "symbol long, n long, aim long")


def flagged(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """d, t (a hash of the text), text and whether the document is a target; only those that may be one are shuffled."""
    own = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    ids = targets.select(F.col("doc_id").cast("long").alias("d")).where("d is not null").distinct()
    marked = own.withColumn("may", may_be_among(docs.sparkSession, ids.select(F.xxhash64("d").alias("h")), F.xxhash64("d")))
    rest = marked.where("not may").drop("may").withColumn("target", F.lit(False))
    hit = ids.withColumn("target", F.lit(True))
    return rest.unionByName(marked.where("may").drop("may").join(hit, "d", "left").fillna(False, ["target"]).select(*rest.columns))


def score(docs: DataFrame, targets: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and ce_difference of every document.

    ``targets`` holds the doc_ids of the target documents; the models are counted on
    ``train``, by default on the scored documents themselves, less each by itself.
    """
    spark = docs.sparkSession
    alone = train is None  # whether a document's own counts are taken off
    odd = F.col("symbol").bitwiseAND(F.lit(1)) == 1
    counts = _counted(flagged(docs if train is None else train, targets)).groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("aim").alias("aim"))
    totals = Observation()
    counts = counts.observe(totals, F.sum(F.when(odd, F.col("n"))).alias("n"), F.sum(F.when(odd, F.col("aim"))).alias("aim"), F.count(F.when(~odd, 1)).alias("words"))
    # A symbol that occurs once has nothing left when that is taken off, so only the others are kept.
    with shuffles_freed(spark):
        shared = written(counts.where("n > 1") if alone else counts)
    total = totals.get
    aimed, rest = int(total["aim"] or 0), int(total["n"] or 0) - int(total["aim"] or 0)
    words = float(max(1, total["words"] - 1))  # without the start mark
    # Of the background and of the target: what a count is worth, and the tokens.
    worth = (aimed / rest if aimed and rest else 1.0, 1.0)
    tokens_of = (float(rest) * worth[0], float(aimed))
    # The most frequent symbols, by a bound on their count that few enough of them reach.
    head = shared.groupBy(F.least(F.col("n"), F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect()  # at most 2^16 rows
    least, many = (1 << 16) + 1, 0
    for r in head:
        if many + r["count"] > MAX_HOT:
            break
        least, many = r["n"], many + r["count"]
    hot = shared.where(F.col("n") >= least).toArrow().sort_by("symbol")
    rare = shared.where(F.col("n") < least)
    aim_of = hot.column("aim").to_numpy()
    sent = spark.sparkContext.broadcast((hot.column("symbol").to_numpy(), (hot.column("n").to_numpy() - aim_of, aim_of), bit_filter(rare.select("symbol"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of_known, bits = sent.value
        start = _START.view(np.int64)

        def losses(symbol: np.ndarray, count: np.ndarray, n: np.ndarray, history: np.ndarray, k: int) -> np.ndarray:
            c = np.maximum(count, 0) * worth[k]
            last = -np.log(c + PRIOR)
            as_word = np.where(symbol == start, 0.0, n * MIX * (last + np.log(tokens_of[k] + PRIOR * words)))
            return np.where(symbol & 1 == 1, n * (1 - MIX) * last, as_word + history * (1 - MIX) * np.log(c + PRIOR * words))

        for batch in batches:
            target = batch.column(2).to_numpy(zero_copy_only=False)
            t = batch.column(1).to_numpy()
            for first, texts, tokens, owner, symbol, own, history in symbols(batch.column(3)):
                if len(known):
                    at = np.searchsorted(known, symbol)
                    at[at == len(known)] = 0
                    here = known[at] == symbol
                else:
                    at, here = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), bool)
                later = ~here & in_filter(bits, symbol)
                sums = []
                for k in range(2):
                    count = np.where(here, of_known[k][at] if len(known) else 0, 0)
                    if alone:
                        count = count - own * (target[first + owner] == bool(k))
                    sums.append(np.bincount(owner, np.where(later, 0.0, losses(symbol, count, own, history, k)), texts))
                row, rows = first + owner[later], first + np.arange(texts)
                at = np.concatenate((row, rows))
                spread = mix(t[rows].view(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                both = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()), y if isinstance(y, pa.Array) else pa.array(y, pa.int64())])
                # The rows of the documents themselves have sums, those of symbols have none.
                sums_of = pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], ["tokens", "background", "aim"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)), pa.array(t[at]), both(symbol[later], spread), both(own[later], pa.nulls(texts, pa.int64())),
                        both(2 * history[later] + target[row], pa.nulls(texts, pa.int64())), pa.concat_arrays([pa.nulls(len(row), sums_of.type), sums_of]),
                    ],
                    ["d", "t", "symbol", "n", "history", "sums"],
                )

    schema = "d long, t long, symbol long, n long, history long, sums struct<tokens: bigint, background: double, aim: double>"
    scored = flagged(docs, targets) if train is None else flagged(docs, targets.limit(0))
    rows = map_batches(scored.select("d", "t", "target", "text"), run, schema)
    # The documents' own rows pass the join by a number that no symbol has. ``history`` is doubled, and odd in a target.
    joined = rows.join(rare.select("symbol", F.col("n").alias("all_n"), F.col("aim").alias("all_aim")), "symbol", "left")
    is_aim = F.col("history").bitwiseAND(F.lit(1)) == 1
    found = (F.coalesce("all_n", F.lit(0)) - F.coalesce("all_aim", F.lit(0)), F.coalesce("all_aim", F.lit(0)))

    def loss(k: int) -> Column:
        off = F.when(is_aim == bool(k), F.col("n")).otherwise(0) if alone else F.lit(0)
        c = F.greatest(found[k] - off, F.lit(0)) * F.lit(worth[k])
        last = -F.log(c + PRIOR)
        as_word = F.when(F.col("symbol") == int(_START.view(np.int64)), 0.0).otherwise(F.col("n") * MIX * (last + math.log(tokens_of[k] + PRIOR * words)))
        as_history = F.shiftright("history", 1) * (1 - MIX) * F.log(c + PRIOR * words)
        return F.when(odd, F.col("n") * (1 - MIX) * last).otherwise(as_word + as_history)

    part = lambda name, k: F.when(F.col("sums").isNull(), loss(k)).otherwise(F.col(f"sums.{name}")).alias(name)
    summed = joined.select("d", "t", F.col("sums.tokens").alias("tokens"), F.col("sums").isNotNull().cast("int").alias("row"), part("background", 0), part("aim", 1)).groupBy("d", "t")
    summed = summed.agg(*[F.sum(c).alias(c) for c in ("tokens", "row", "background", "aim")])
    # Rows with equal id and text have met here; each gets its row back.
    each = summed.select("d", "row", "tokens", "background", "aim", F.explode(F.expr("sequence(1, cast(row as int))")).alias("one"))
    mean = lambda c, name: F.when(F.col("tokens") > 0, F.round(F.col(c) / F.col("tokens"), 6)).alias(name)
    difference = F.when(F.col("tokens") > 0, F.round((F.col("aim") - F.col("background")) / F.col("tokens"), 6))
    return each.select(F.col("d").alias("doc_id"), (F.col("tokens") / F.col("row")).cast("long").alias("n_tokens"), mean("aim", "target_loss"), mean("background", "background_loss"), difference.alias("ce_difference"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses and score; the target is the documents labelled as of good quality."""
    targets = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), targets)


def oracle_sql() -> dict[str, str]:
    return {}


def queries() -> dict:
    return {"op7_lm_scoring": op7_lm_scoring}
