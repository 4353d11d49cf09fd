"""Line dedup by winnowing over line hashes, and over word hashes.

A text is a sequence of lines with a word in them. A gram is the shortest run of
whole lines, from a given line on, of at least ``GRAM_WORDS`` words. Of the grams
inside every run of ``RUN_WORDS`` words the one with the least hash is selected,
so whatever runs of that many words two places share, they share a selected gram
(a fingerprint) at the same place in it. Each fingerprint is joined with the
first place that has it, in the order of (doc_id, position); the match is
extended line by line both ways; and the later place's lines are deleted. Lines
are equal when their words are. A line that is deleted equals an earlier one, and
the first of equal lines is never the later place, so one copy of every line stays.

Runs that start or end inside a line are found in the same way with words for
lines: a gram is ``GRAM_WORDS`` words in a row, wherever lines break, matches are
extended word by word, and a match of ``RUN_WORDS`` words or more is deleted,
down to a part of a line. A fingerprint of words that comes again within a gram's
length is compared with its last place, so that a short period repeated many
times gives few matches.

A text that equals one with a smaller doc_id and has ``RUN_WORDS`` words is
deleted whole without any of this; only the first of equal texts is matched.

Guarantee: of a run of at least ``RUN_WORDS`` words that repeats an earlier run,
the part around its fingerprints is deleted; where the earlier run is the first
that has these fingerprints, that is the whole run. This holds for runs of words
as for runs of whole lines. No match of fewer than ``GRAM_WORDS`` words on whole
lines, or of fewer than ``RUN_WORDS`` words elsewhere, ever deletes anything.

Plan: the texts are read three times, and no hash of a text leaves its task
unless it is shared. First only fingerprints are counted; those that two texts
have go into a filter of fixed size. Then their places are joined with the first
ones. Last, the word hashes of the documents with a match are sent to it. A match
is a pair of documents, with all places they share: no step gathers the places of
a fingerprint, the first place being a partial aggregate, and the joins can be
split where they are hot. Only documents with something to delete are shuffled.

Defined results for odd input: a null or empty text has no lines and stays; rows
with the same doc_id and text count as one document, each row getting its
result; a null doc_id comes before all others; blank lines stay or go with the
line before them; an empty table gives no rows; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import WORD_SEPARATORS, bit_filter, checkpoint, free_name, give_back_memory, in_filter, map_batches, ship_package, table, written
from arcstep.llm.shingles import BLOCK_BYTES, mix, word_blocks

#: No run of fewer words is deleted.
GRAM_WORDS = 25
#: A repeated run of this many words is certain to be found.
RUN_WORDS = 50

_WORD = re.compile(f"[^{WORD_SEPARATORS}]+")
_BASE = 0x9E3779B97F4A7C15
#: Tell the fingerprints of lines from those of words.
_LINES, _WORDS = np.uint64(0), np.uint64(1)


class _Powers:
    """The powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << max(12, n.bit_length())
            power = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, dtype=np.uint64))))
            self.up, self.down = power(_BASE), power(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _spans_hashed(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words from each first to before each last, the same wherever the span is."""
    up, down = _POWERS.first(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])))
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def _least(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least key from each first to before each last; the earliest of equal ones."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    level = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    width = last - first
    out = np.zeros(len(first), dtype=np.uint64)
    step = 1
    while len(width):
        now = (width >= step) & (width < 2 * step)
        if now.any():
            out[now] = np.minimum(level[first[now]], level[last[now] - step])
        if not (width >= 2 * step).any():
            break
        level = np.minimum(level[:-step], level[step:])
        step *= 2
    return (out & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Texts:
    """The word hashes of several texts in a row; cuts[i] is the first word of text i, and ends the word after each line with a word."""

    def __init__(self, hashes: np.ndarray, cuts: np.ndarray, ends: np.ndarray) -> None:
        self.hashes, self.cuts, self.ends = hashes, cuts, ends

    def _lines(self, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the selected grams of lines, and their hashes."""
        ends = self.ends
        starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
        limit = self.cuts[np.searchsorted(self.cuts, starts, "right")]
        # The last lines of the gram and of the run from each line on; the number of lines where too few words follow.
        gram = np.searchsorted(ends, starts + gram_words)
        run = np.searchsorted(ends, starts + run_words)
        whole = lambda at: (at < len(ends)) & (np.append(ends, 1 << 62)[at] <= limit)
        ok, first = whole(gram), np.flatnonzero(whole(run))
        keys = np.full(len(ends), ~np.uint64(0))
        keys[ok] = _spans_hashed(self.hashes, starts[ok], ends[gram[ok]])
        chosen = np.unique(_least(keys, first, np.searchsorted(gram, run[first], "right")))
        return starts[chosen], keys[chosen]

    def _words(self, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the selected grams of words, and their hashes."""
        first = np.arange(max(0, len(self.hashes) - run_words + 1))
        first = first[first + run_words <= self.cuts[np.searchsorted(self.cuts, first, "right")]]
        at = np.arange(max(0, len(self.hashes) - gram_words + 1))
        keys = _spans_hashed(self.hashes, at, at + gram_words)
        chosen = np.unique(_least(keys, first, first + run_words - gram_words + 1))
        return chosen, keys[chosen]

    def fingerprints(self, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, fingerprints, first words in the text, gaps, and whether the text has the fingerprint again.

        A gap is the distance from the same gram of words' last selected place, 0 if that is over ``gram_words``.
        """
        (la, lk), (wa, wk) = self._lines(gram_words, run_words), self._words(gram_words, run_words)
        at = np.concatenate((la, wa))
        prints = np.concatenate((lk & ~np.uint64(1) | _LINES, wk & ~np.uint64(1) | _WORDS))
        text = np.searchsorted(self.cuts, at, "right") - 1
        gaps, again = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        order = np.lexsort((at, prints, text))
        same = np.flatnonzero((prints[order[1:]] == prints[order[:-1]]) & (text[order[1:]] == text[order[:-1]])) + 1
        if len(same):
            apart = at[order[same]] - at[order[same - 1]]
            gaps[order[same]] = np.where((apart <= gram_words) & (prints[order[same]] & np.uint64(1) == _WORDS), apart, 0)
            again[order[same]] = again[order[same - 1]] = True
        return text, prints.view(np.int64), at - self.cuts[text], gaps, again


def texts_of(column: pa.Array | list) -> Iterator[tuple[int, Texts]]:
    """Blocks of texts of bounded size, and the place of the first one of each."""
    raws = column.cast(pa.binary()).to_pylist() if isinstance(column, pa.Array) else [None if x is None else x.encode() for x in column]
    for at, hashes, cuts, ends in word_blocks(raws):
        yield at, Texts(hashes, cuts, ends)


def _key() -> tuple:
    """A document's key: its id, nulls first, and a hash of its text; and a hash of both."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    t = F.xxhash64(F.col("text").cast("string"))
    return d.alias("d"), t.alias("t"), F.xxhash64(d, t).alias("k")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_key(), F.col("text").cast("string").alias("text"))


def later_copies(docs: DataFrame) -> DataFrame:
    """d, t and k of the documents whose text one with a smaller id has, too."""
    keys = docs.select(*_key()).distinct()
    first = docs.select(*_key()).groupBy("t").agg(F.min("d").alias("d"))
    return keys.join(first, ["d", "t"], "left_anti")


def shared_prints(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The fingerprints that two different texts have, or one text twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for at, block in texts_of(batch.column(1)):
                text, prints, _, _, again = block.fingerprints(gram_words, run_words)
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(names[at + text]), pa.array(again)], ["print", "t", "again"])

    found = map_batches(_texts(docs).select("t", "text"), run, "print long, t long, again boolean")
    return found.groupBy("print").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("again").alias("again")).where("again or a <> b").select("print")


def shared_places(docs: DataFrame, bits: np.ndarray, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """d, t, k, print, pos and gap of the fingerprints that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            d, t, k = (batch.column(i).to_numpy() for i in range(3))
            for at, block in texts_of(batch.column(3)):
                text, prints, places, gaps, _ = block.fingerprints(gram_words, run_words)
                hit = in_filter(known, prints)
                row = at + text[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[row]), pa.array(t[row]), pa.array(k[row]), pa.array(prints[hit]), pa.array(places[hit].astype(np.int32)), pa.array(gaps[hit].astype(np.int32))],
                    ["d", "t", "k", "print", "pos", "gap"],
                )

    return map_batches(_texts(docs), run, "d long, t long, k long, print long, pos int, gap int")


def matched_places(places: DataFrame) -> DataFrame:
    """d, t, d0, t0 and anchors: for every pair of documents the places (pos, pos0, words) of fingerprints that the second has first."""
    # A table of its own, so that the join with a hot fingerprint's places can be split.
    first = written(
        places.where("gap = 0").groupBy("print").agg(F.min(F.struct("d", "t", "pos")).alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1")
        .select("print", F.col("at.d").alias("d0"), F.col("at.t").alias("t0"), F.col("at.pos").alias("pos0"))
    )
    apart = places.where("gap = 0").join(first, "print").where("not (d = d0 and t = t0 and pos = pos0)")
    near = places.where("gap > 0").select("print", "d", "t", "k", "pos", "gap", F.col("d").alias("d0"), F.col("t").alias("t0"), (F.col("pos") - F.col("gap")).alias("pos0"))
    both = apart.select(*near.columns).union(near)
    words = (F.col("print").bitwiseAND(F.lit(1)) == 1).alias("words")
    return both.groupBy("d", "t", "d0", "t0").agg(F.collect_set(F.struct("pos", "pos0", words)).alias("anchors"))


def matched_words(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """d, t, hashes of the words and ends of the lines of the documents that have a part in a match."""
    key = lambda d, t: matches.select(F.xxhash64(d, t).alias("k"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(key("d", "t").union(key("d0", "t0"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(in_filter(sent.value, batch.column(2).to_numpy())))
            for at, block in texts_of(own.column(3)):
                n, cuts = len(block.cuts) - 1, block.cuts
                lines = np.searchsorted(block.ends, cuts, "right")
                shift = np.repeat(cuts[:-1], np.diff(lines))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).slice(at, n), own.column(1).slice(at, n),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(block.hashes.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lines.astype(np.int32)), pa.array((block.ends - shift).astype(np.int32))),
                    ],
                    ["d", "t", "hashes", "ends"],
                )

    return map_batches(_texts(docs), run, "d long, t long, hashes array<long>, ends array<int>").dropDuplicates(["d", "t"])


def _equal(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many units from i on equal those from j on."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 64
    while done < most:
        n = min(step, most - done)
        same = a[i + done : i + done + n] == b[j + done : j + done + n]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + n, step * 4
    return most


def extend(own: np.ndarray, source: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of equal units around anchors (place, place in the source)."""
    runs: list[tuple[int, int]] = []
    shift = end = None
    for _, i, j in sorted((i - j, i, j) for i, j in anchors):
        if shift == i - j and i < end:
            continue
        shift = i - j
        end = i + _equal(own, source, i, j)
        if end > i:
            runs.append((i - _equal(own[:i][::-1], source[:j][::-1], 0, 0), end))
    return runs


def repeated_words(docs: DataFrame, matches: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """d, t and spans, array<struct(first, last)>: the words to delete, ``last`` excluded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = [], []
            for anchors, words0, ends0, words, ends in zip(*batch.columns[2:], strict=True):
                words0, ends0, words, ends = (x.values.to_numpy() for x in (words0, ends0, words, ends))
                pos, pos0, of_words = (anchors.values.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "pos0", "words"))
                in_words = list(zip(pos[of_words].tolist(), pos0[of_words].tolist(), strict=True))
                spans = [(a, b) for a, b in extend(words, words0, in_words) if b - a >= run_words]
                starts, starts0 = (np.concatenate(([0], e[:-1])) for e in (ends, ends0))
                in_lines = list(zip(np.searchsorted(starts, pos[~of_words]).tolist(), np.searchsorted(starts0, pos0[~of_words]).tolist(), strict=True))
                if in_lines:
                    lines, lines0 = (_spans_hashed(w.view(np.uint64), s, e) for w, s, e in ((words, starts, ends), (words0, starts0, ends0)))
                    spans += [(int(starts[a]), int(ends[b - 1])) for a, b in extend(lines, lines0, in_lines)]
                firsts.append([a for a, _ in spans])
                lasts.append([b for _, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], ["d", "t", "firsts", "lasts"]
            )

    units = matched_words(docs, matches)
    source = units.select(F.col("d").alias("d0"), F.col("t").alias("t0"), F.col("hashes").alias("words0"), F.col("ends").alias("ends0"))
    both = matches.join(source, ["d0", "t0"]).join(units.select("d", "t", "hashes", "ends"), ["d", "t"]).select("d", "t", "anchors", "words0", "ends0", "hashes", "ends")
    runs = map_batches(both, run, "d long, t long, firsts array<int>, lasts array<int>").where("size(firsts) > 0")
    spans = F.expr("transform(arrays_zip(firsts, lasts), x -> struct(x.firsts as first, x.lasts as last))")
    return runs.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list(spans))).alias("spans"))


def _without(line: str, dead: np.ndarray) -> str:
    """The line without its dead words, of which it has others; the white space before the next word goes with them."""
    found = list(_WORD.finditer(line))
    out, at = [], 0
    for i, word in enumerate(found):
        if dead[i]:
            if i and not dead[i - 1]:
                out.append(line[at : word.start()])
            at = found[i + 1].start() if i + 1 < len(found) else word.end()
            if i == 0:
                out.append(line[: word.start()])
    kept = "".join(out)
    return (kept.rstrip(WORD_SEPARATORS) if dead[-1] else kept) + line[at:]


def delete_words(text: str | None, spans: list[dict] | None, whole: bool = False, run_words: int = RUN_WORDS) -> tuple[str | None, int, int, int]:
    """The text without the spans' words, or without any if it is a ``whole`` copy; lines with a word, lines and words deleted."""
    if not text:
        return text, 0, 0, 0
    lines = text.split("\n")
    places = [i for i, line in enumerate(lines) if line.strip(WORD_SEPARATORS)]
    if not spans and not whole:
        return text, len(places), 0, 0
    words = [len(lines[i].encode().split()) for i in places]
    ends = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    if whole:
        spans = [{"first": 0, "last": int(ends[-1])}] if ends[-1] >= run_words else []
    gone = np.zeros(ends[-1] + 1, dtype=np.int64)
    for x in spans or ():
        gone[x["first"]] += 1
        gone[x["last"]] -= 1
    dead = np.cumsum(gone)[:-1] > 0
    if not dead.any():
        return text, len(places), 0, 0
    left = np.array(words, dtype=np.int64) - np.add.reduceat(dead.astype(np.int64), ends[:-1])
    keep = np.ones(len(lines), dtype=bool)
    for k, place in enumerate(places):  # blank lines share the fate of the line before them
        if not left[k]:
            keep[place : places[k + 1] if k + 1 < len(places) else len(lines)] = False
        elif left[k] < words[k]:
            lines[place] = _without(lines[place], dead[ends[k] : ends[k + 1]])
    kept = "\n".join(line for line, stays in zip(lines, keep, strict=True) if stays)
    return kept, len(places), int((left == 0).sum()), int(dead.sum())


def found_repeats(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """d, t, spans and whole of every document with something to delete."""
    copies = checkpoint(later_copies(docs))
    bits = bit_filter(shared_prints(docs, gram_words, run_words))
    places = shared_places(docs, bits, gram_words, run_words).join(copies.select("d", "t"), ["d", "t"], "left_anti").dropDuplicates(["d", "t", "print", "pos"])
    matches = checkpoint(matched_places(checkpoint(places)))
    spans = repeated_words(docs, matches, run_words).withColumn("whole", F.lit(False))
    return checkpoint(spans.unionByName(copies.select("d", "t", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole"))))


def dedup_text(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, column: str = "dedup") -> DataFrame:
    """``docs`` without repeated runs, and struct ``column`` (n_lines, n_removed, removed_words, n_words) beside its columns.

    A name that cannot clash is ``free_name("dedup", docs.columns)``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    found = found_repeats(docs, gram_words, run_words)
    sent = spark.sparkContext.broadcast(bit_filter(found.select(F.xxhash64("d", "t").alias("k"))))
    # Names of its own for the keys; the text's column is replaced in its place.
    d, t, k, spans, whole, done = (free_name(x, [*docs.columns, column]) for x in ("d", "t", "k", "spans", "whole", "done"))
    keyed = docs.withColumns(dict(zip((d, t, k), _key())))
    fields = "n_lines: long, n_removed: long, removed_words: long, n_words: long"

    def hit(keys: pa.Array) -> pa.Array:
        return pa.array(in_filter(sent.value, keys.to_numpy(zero_copy_only=False)))

    def look(keys: pa.Array, texts: pa.Array) -> pa.Array:
        """The measures of texts that have nothing to delete for certain; null for the others."""
        rest = ~in_filter(sent.value, keys.to_numpy(zero_copy_only=False))
        lines, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), 256):
            for i, text in enumerate(texts.slice(at, 256).cast(pa.binary()).to_pylist(), at):
                if text and rest[i]:
                    words[i], lines[i] = len(text.split()), sum(1 for x in text.split(b"\n") if x and not x.isspace())
        none = pa.array(np.zeros(len(texts), np.int64))
        return pa.StructArray.from_arrays([pa.array(lines), none, none, pa.array(words)], ["n_lines", "n_removed", "removed_words", "n_words"], mask=pa.array(~rest))

    def cut(texts: pa.Array, all_spans: pa.Array, copies: pa.Array) -> pa.Array:
        rows: list[list] = [[] for _ in range(5)]
        for at in range(0, len(texts), 256):
            part = (x.slice(at, 256).to_pylist() for x in (texts, all_spans, copies))
            for text, own, copy in zip(*part, strict=True):
                out = delete_words(text, own, bool(copy), run_words)
                for values, value in zip(rows, (*out, len((text or "").encode().split())), strict=True):
                    values.append(value)
        give_back_memory()
        return pa.StructArray.from_arrays([pa.array(rows[0], pa.string()), *[pa.array(x, pa.int64()) for x in rows[1:]]], ["text", "n_lines", "n_removed", "removed_words", "n_words"])

    text = F.col("text").cast("string")
    rest = keyed.withColumn(column, F.arrow_udf(look, f"struct<{fields}>")(F.col(k), text)).where(F.col(column).isNotNull()).withColumn("text", text).drop(d, t, k)
    named = found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("spans").alias(spans), F.col("whole").alias(whole))
    touched = keyed.where(F.arrow_udf(hit, "boolean")(F.col(k))).join(named, [d, t], "left").drop(d, t, k)
    touched = touched.withColumn(done, F.arrow_udf(cut, f"struct<text: string, {fields}>")(text, F.col(spans), F.col(whole)))
    measures = F.struct(*[F.col(done)[x].alias(x) for x in ("n_lines", "n_removed", "removed_words", "n_words")])
    return rest.unionByName(touched.withColumns({"text": F.col(done)["text"], column: measures}).drop(spans, whole, done))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_text(docs).select("doc_id", "text", "dedup.n_lines", "dedup.n_removed", "dedup.removed_words")


def oracle_sql() -> dict[str, str]:
    return {}


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup}
