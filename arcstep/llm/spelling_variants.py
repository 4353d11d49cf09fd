"""Spelling variants of words, found by one-error searches in two-way FM-indexes.

The words of all texts are counted; those seen often enough are the vocabulary.
Two words are near if one inserted, deleted or replaced code point parts them.
Whichever it is, one half of the shorter word stands unchanged at the same end of
both. So every word goes to where the words of its first half are and to where
those of its second half are (and, as one with a letter too many, to where the
halves of words shorter by one are), and there is looked up in an FM-index of the
vocabulary, its words between delimiters: backward in the words as they are, for
the second half, or in the words reversed, for the first half. A search matches a
delimiter and the half exactly, which leaves an interval of suffix ranks; then it
goes on across the other half with one error allowed, a state for each interval
that is left, up to the delimiter at the far end, whose rank is the word. Only
replacements by a greater letter and deletions of the first of equal letters are
followed, so every pair is found exactly once; insertions are deletions seen from
the other word.

Plan: counting words is a partial aggregate in the tasks that read the texts, so
what is shuffled follows the vocabularies of the partitions. Halves are dealt into
buckets of bounded size. A half that too many words share is split: its words are
dealt over several indexes, and each of its searches goes to all of them. The roots
of chains of forms come from pointer doubling; since a form is at least twice as
frequent as its variant, ``ROUNDS`` rounds are enough for any counts.

Defined results for odd input: a null or empty text has no words; a null doc_id is
hashed like an empty one; rows that repeat count each; words of any length are
taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import ceil_div, discard, map_batches, ship_package, shuffle_width, table, written

#: The least code points of a word, and how often it must occur.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many of a document's distinct words loses a code point, which makes variants to be found.
ERROR_EVERY = 97
#: Words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Rows of a bucket on average, and at most of one half in one index.
BUCKET_ROWS = 60_000
#: Every form is at least twice as frequent, so a chain has at most 62 links.
ROUNDS = 6

#: Letters as they are or lower-cased, the lead byte and the later bytes of U+00C0 to U+00FF, a space for all else.
_LETTERS = {c: c for c in (*string.ascii_lowercase.encode(), 0xC3, *range(0x80, 0xC0))} | dict(zip(string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), strict=True))
_TABLE = bytes(_LETTERS.get(c, 0x20) for c in range(256))
#: Later bytes that begin a token come from other characters: their lead byte is a space.
_STRAY = bytes(range(0x80, 0xC0))


# -- the vocabulary -----------------------------------------------------------


def document_words(key: int | None, raw: bytes, error_every: int = ERROR_EVERY) -> Iterator[tuple[bytes, int]]:
    """The words of a text that are long enough, with the errors put in, and their counts; a word may come more than once."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for word, n in Counter(raw.translate(_TABLE).split()).items():
        if 0x80 <= word[0] < 0xC0:
            word = word.lstrip(_STRAY)
        size = len(word) - word.count(0xC3)
        if size < LEAST_LENGTH:
            continue
        h = zlib.crc32(word, start)
        if h % error_every == 0:
            if size == LEAST_LENGTH:
                continue
            at, letters = h % size, word.decode()
            word = (letters[:at] + letters[at + 1 :]).encode()
        yield word, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` code points that occur ``LEAST_COUNT`` times in all texts."""

    def handed(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for word, n in document_words(key, raw.as_py() or b""):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD_WORDS:
                    yield handed(counts)
        yield handed(counts)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_batches(texts, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- the index ----------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; ``text`` has distinct numbers at delimiters, so order is settled by the longest word."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate((np.zeros(1, np.int64), (np.diff(key[order]) != 0).astype(np.int64))))
        rank, width = new, 2 * width
        if rank.max() == n - 1 or width >= n:
            return order


class Index:
    """An FM-index of distinct words between delimiters, the Burrows-Wheeler transform held as a wavelet matrix.

    ``codes`` and ``cuts`` hold the words in order: word i is codes[cuts[i]:cuts[i + 1]],
    letters from 1 on. Suffixes that begin with delimiters come first, in the order of
    the words behind them, so the rank of a whole word between delimiters is the word's number.
    """

    def __init__(self, codes: np.ndarray, cuts: np.ndarray, letters: int) -> None:
        count = len(cuts) - 1
        self.count = count
        size = len(codes) + count + 1
        at = cuts + np.arange(count + 1)  # places of the delimiters
        text = np.zeros(size, np.int64)
        inner = np.ones(size, bool)
        inner[at] = False
        text[inner] = codes + count
        text[at] = np.arange(count + 1)
        order = suffix_order(text)
        symbols = np.zeros(size, np.uint8)
        symbols[inner] = codes
        #: A symbol greater than all letters stands before the first delimiter.
        self.none = letters + 1
        before = symbols[order - 1]
        before[order == 0] = self.none
        self.bits = max(1, int(self.none).bit_length())
        firsts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(symbols, minlength=self.none + 1))))[: self.none + 1]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for k in reversed(range(self.bits)):
            high = (before >> k & 1).astype(bool)
            ones = np.zeros(size + 1, np.int32)
            np.cumsum(high, out=ones[1:])
            self.levels.append((k, ones, size - int(ones[-1])))
            before = np.concatenate((before[~high], before[high]))
        starts = self._down(np.arange(self.none + 1), np.zeros(self.none + 1, np.int64))
        self.shift = firsts - starts

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ones, zeros in self.levels:
            one = ones[at]
            at = np.where(symbols >> k & 1, zeros + one, at - one)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a symbol put before what they match."""
        both = self._down(np.concatenate((symbols, symbols)), np.concatenate((low, high))) + np.tile(self.shift[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def branches(self, low: np.ndarray, high: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each letter greater than ``above`` before what an interval matches: the interval's place, and the new interval."""
        source, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k, ones, zeros in self.levels:
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            with_one = b > a
            # Letters from here on are at most the symbol with all later bits set.
            with_zero = (high - low > b - a) & ((symbol | (1 << k) - 1) > above[source])
            low, high = np.concatenate((low[with_zero] - a[with_zero], zeros + a[with_one])), np.concatenate((high[with_zero] - b[with_zero], zeros + b[with_one]))
            symbol = np.concatenate((symbol[with_zero], symbol[with_one] | 1 << k))
            source = np.concatenate((source[with_zero], source[with_one]))
        keep = (symbol > above[source]) & (symbol != self.none)
        low, high, symbol, source = low[keep], high[keep], symbol[keep], source[keep]
        return source, low + self.shift[symbol], high + self.shift[symbol]

    def search(self, patterns: np.ndarray, exact: int, error_from: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of the words that differ by one error from a pattern.

        ``patterns`` has a row of letters for each, all of one length, last letter first. The
        first ``exact`` letters have to match. From ``error_from`` on a letter may be replaced
        by a greater one or, where ``allowed`` is given and true, be left out.
        """
        n, length = patterns.shape
        who = np.arange(n)
        low, high = np.zeros(n, np.int64), np.full(n, self.count + 1, np.int64)
        owner, a, b = who[:0], low[:0], high[:0]  # states with the error behind them
        for t in range(length):
            if len(owner):
                a, b = self.extend(a, b, patterns[owner, t])
                left = a < b
                owner, a, b = owner[left], a[left], b[left]
            letters = patterns[who, t]
            if t >= max(exact, error_from):
                if allowed is None:
                    source, c, d = self.branches(low, high, letters)
                else:
                    source = np.flatnonzero(allowed[who, t])
                    c, d = low[source], high[source]
                owner, a, b = np.concatenate((owner, who[source])), np.concatenate((a, c)), np.concatenate((b, d))
            low, high = self.extend(low, high, letters)
            left = low < high
            who, low, high = who[left], low[left], high[left]
        a, b = self.extend(a, b, np.zeros(len(a), np.int64))
        found = a < b
        return owner[found], a[found]


# -- searches in a bucket -----------------------------------------------------


def _coded(words: list[str], back: bool) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """The words (reversed if ``back`` is not set), their letters as numbers from 1 on, the words' cuts, and how many letters there are."""
    turned = words if back else [w[::-1] for w in words]
    points = np.frombuffer("".join(turned).encode("utf-32-le"), dtype="<u4")
    letters, codes = np.unique(points, return_inverse=True)
    cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, turned), np.int64, len(turned)))))
    return turned, codes.astype(np.int64) + 1, cuts, len(letters)


def near_in_bucket(words: list[str], indexed: np.ndarray, shorter: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (a, b) of near pairs that share the half at the end (``back``) or the beginning.

    ``indexed`` words are in the index. The others look for words of their own length,
    or, where ``shorter`` is set, for words with one letter less; indexed ones do the former too.
    """
    turned, codes, cuts, letters = _coded(words, back)
    own = np.flatnonzero(indexed)
    own = own[np.array(sorted(range(len(own)), key=lambda k: turned[own[k]]), dtype=np.int64)] if len(own) else own
    sizes = np.diff(cuts)
    if not len(own):
        return own, own
    take = np.repeat(cuts[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
    index = Index(codes[take], np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[own]))), letters)
    first, second = [], []
    for drop in (False, True):
        asking = shorter if drop else ~shorter
        for length in np.unique(sizes[asking]).tolist():
            group = np.flatnonzero(asking & (sizes == length))
            half = (length - drop) // 2
            exact = length - drop - half if back else half
            # Errors may be in the other half; a deletion at its end belongs to the search from the other side.
            error_from = exact + 1 if back and drop else exact
            # A block holds a bounded number of letters, however long the words are.
            step = max(1, (1 << 21) // length)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                patterns = codes[cuts[part][:, None] + np.arange(length - 1, -1, -1)[None, :]]
                allowed = None
                if drop:
                    # Of equal letters in a row, only the first in the word is left out.
                    allowed = np.ones(patterns.shape, bool)
                    if back:
                        allowed[:, :-1] = patterns[:, :-1] != patterns[:, 1:]
                    else:
                        allowed[:, 1:] = patterns[:, 1:] != patterns[:, :-1]
                who, word = index.search(patterns, exact, error_from, allowed)
                first.append(part[who])
                second.append(own[word])
    return np.concatenate(first), np.concatenate(second)


def _routes(words: DataFrame) -> DataFrame:
    """(word, n, back, shorter, half) of every place a word goes to: the halves of its own length, and of one letter less."""
    length = F.length("word")

    def routes(shorter: bool) -> list:
        size = length - 1 if shorter else length
        half = F.floor(size / 2).cast("int")
        kinds = ((False, F.substring("word", F.lit(1), half)), (True, F.substring("word", length - (size - half) + 1, size - half)))
        return [F.struct(F.lit(back).alias("back"), F.lit(shorter).alias("shorter"), F.concat_ws(":", F.lit(str(back)), size.cast("string"), part).alias("half")) for back, part in kinds]

    places = F.when(length > LEAST_LENGTH, F.array(*routes(False), *routes(True))).otherwise(F.array(*routes(False)))
    return words.select("word", "n", F.explode(places).alias("r")).select("word", "n", "r.*")


_PAIRS = "word string, n long, near string, near_n long"


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for the near pairs of (word, n), each pair once.

    ``words`` is read three times, so it should be a written table.
    """
    ship_package(words.sparkSession)
    routes = _routes(words)
    total = words.count()
    rows = min(BUCKET_ROWS, max(2_000, ceil_div(2 * total, shuffle_width(words))))
    buckets = max(1, ceil_div(2 * total, rows))
    # A half that more words share than a bucket holds is split over as many indexes as it needs.
    hot = routes.where("not shorter").groupBy("half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rows).select("half", F.ceil(F.col("c") / rows).cast("int").alias("parts"))
    dealt = routes.join(hot, "half", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # A word is in one index of its half and asks in all; where it is not indexed, it only asks. There are more
    # buckets than parts, so the parts of a half are in different buckets.
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("indexed", ~F.col("shorter") & (F.col("part") == own))
    dealt = dealt.select("word", "n", "back", "shorter", "indexed", F.pmod(F.xxhash64("half") + F.col("part"), F.lit(buckets)).cast("int").alias("bucket"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        names = group.column("word").to_pylist()
        flag = lambda c: group.column(c).to_numpy(zero_copy_only=False).astype(bool)
        a, b = near_in_bucket(names, flag("indexed"), flag("shorter"), key[0].as_py())
        columns = [group.column(c).combine_chunks().take(pa.array(i)) for i in (a, b) for c in ("word", "n")]
        return pa.Table.from_arrays(columns, ["word", "n", "near", "near_n"])

    return dealt.groupBy("back", "bucket").applyInArrow(search, _PAIRS)


# -- forms and roots ----------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the end of each word's chain of forms, by pointer doubling."""
    state = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(ROUNDS):
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, state = state, written(
            state.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        )
        discard(last)
        if state.where("moved").isEmpty():
            break
    return state.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the whole vocabulary: the most frequent near word, if twice as frequent, and where its chain ends."""
    words = written(vocabulary(docs))
    pairs = near_pairs(words)
    sides = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    near = pairs.select(sides.alias("s")).groupBy("s.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.near_n")).alias("m"), "s.near")).alias("best"))
    judged = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f")
        )
    ).select("word", "f.form", "n", "n_near", "f.form_n")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs WHERE length(w) >= 5 GROUP BY ALL),
byt AS (SELECT *, list_transform(flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END)), lambda b: b::BIGINT) AS bs FROM own),
crc AS (SELECT doc_id, w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h FROM byt, tab),
err AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END AS w, c FROM crc),
voc AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS n FROM err WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
cut AS MATERIALIZED (SELECT w, n, i, w[1:i - 1] || w[i + 1:] AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM voc)),
pair AS (SELECT a.w AS a, b.w AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT a.w, v.w FROM cut a JOIN voc v ON v.w = a.rest UNION SELECT v.w, a.w FROM cut a JOIN voc v ON v.w = a.rest),
near AS (SELECT p.a AS w, count(*) AS n_near, arg_min(v.w, (-v.n, encode(v.w))) AS best, max(v.n) AS best_n FROM (SELECT DISTINCT a, b FROM pair) p JOIN voc v ON v.w = p.b GROUP BY p.a),
form AS MATERIALIZED (SELECT voc.w, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * voc.n THEN best END AS form, CASE WHEN best_n >= 2 * voc.n THEN best_n END AS form_n FROM voc LEFT JOIN near ON near.w = voc.w),
chain(w, z) AS (SELECT w, w FROM form UNION ALL SELECT c.w, f.form FROM chain c JOIN form f ON f.w = c.z WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, (SELECT c.z FROM chain c JOIN form e ON e.w = c.z WHERE c.w = f.w AND e.form IS NULL) AS root, f.n, f.n_near, f.form_n FROM form f
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": _SQL}


def queries() -> dict:
    return {"op11_spelling_variants": op11_spelling_variants}
