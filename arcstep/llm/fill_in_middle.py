"""Fill-in-the-middle texts, cut with a wavelet matrix over character classes.

A text is a sequence of units (lines, or runs of characters of one class) and is
cut into prefix, middle and suffix at two unit boundaries, which a hash of the
document's id chooses. Every character becomes one of six symbols; a wavelet
matrix over them answers how many of a symbol lie before a place (rank) and where
the k-th one is (select). The number of boundaries before a place is a sum of
ranks, so both cuts are found without a list of the units: by select where one
symbol makes the boundaries, by bisection on the sum where several do. A level
of the matrix takes a bit and a half for a character, so texts of any length are
cut whole.

Three arrangements: ``psm`` writes prefix, suffix, middle, ``spm`` suffix, prefix,
middle, each part behind its sentinel; ``plain`` leaves the text as it is. A text
that holds a sentinel stays plain, so that ``restored`` always gives back the text.

Defined results for odd input: a null or empty text has no units and stays plain;
a null doc_id is hashed like an empty one; rows that repeat get equal results; an
empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import free_name, give_back_memory, ship_package, table

#: The symbols: white space, a newline, and the later and the first characters of runs of letters and digits, and of others.
SPACE, NEWLINE, WORD, WORD_START, OTHER, OTHER_START = range(6)
_BITS = 3
#: What makes the boundaries of a unit: the symbols, and whether the boundary lies behind them.
UNITS: dict[str, tuple[tuple[int, ...], bool]] = {"line": ((NEWLINE,), True), "run": ((WORD_START, OTHER_START), False)}
#: Characters that are classified at once, and characters of short texts that share a matrix.
BLOCK = 1 << 20

_RESULT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


@dataclass(frozen=True)
class Template:
    """The sentinels, the unit of the cuts, the seed of the hash, and the shares in percent: of texts that are cut, and of those for spm."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        overlap = any(x[-k:] == y[:k] for x in marks for y in marks for k in range(1, min(len(x), len(y)) + (x != y)))
        if not all(marks) or any(x in y for x in marks for y in marks if x is not y) or overlap:
            raise ValueError("sentinels must be non-empty, and none may hold another or begin as one ends")
        if self.unit not in UNITS:
            raise ValueError(f"unknown unit {self.unit}")


class BitVector:
    """Bits with rank and select, in 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view(np.uint64)
        self.ones_before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros_before = 64 * np.arange(len(self.ones_before), dtype=np.int64) - self.ones_before

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones_before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """The place of the k-th set (or clear) bit, from 0."""
        before = self.ones_before if bit else self.zeros_before
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        held = self.words[word] if bit else ~self.words[word]
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((held >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = here <= left
            left -= here * beyond
            at += width * beyond
        return 64 * word + at


class WaveletMatrix:
    """A sequence of small symbols with rank and select for all of them."""

    def __init__(self, symbols: np.ndarray, bits: int = _BITS) -> None:
        self.size, self.levels = len(symbols), []
        for k in reversed(range(bits)):
            high = (symbols >> k & 1).astype(bool)
            self.levels.append((k, BitVector(high), len(symbols) - int(high.sum())))
            symbols = np.concatenate((symbols[~high], symbols[high]))

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places end in the bottom order of ``symbol``."""
        for k, level, zeros in self.levels:
            ones = level.ones(at)
            at = zeros + ones if symbol >> k & 1 else at - ones
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` lie before each place."""
        return self._down(symbol, at) - self._down(symbol, np.zeros(1, np.int64))

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th ``symbol``, from 0."""
        at = self._down(symbol, np.zeros(1, np.int64)) + k
        for bit, level, zeros in reversed(self.levels):
            one = bool(symbol >> bit & 1)
            at = level.select(at - zeros if one else at, one)
        return at

    def rank_of(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of any of ``symbols`` lie before each place."""
        return sum(self.rank(s, at) for s in symbols)

    def select_of(self, symbols: Sequence[int], k: np.ndarray) -> np.ndarray:
        """The place of the k-th of any of ``symbols``: by select for one, by bisection on the ranks for several."""
        if len(symbols) == 1:
            return self.select(symbols[0], k)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.size, np.int64)
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.rank_of(symbols, mid + 1) > k
            low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
        return low


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The symbol of every code point as a later character of its run."""
    kind = lambda c: NEWLINE if c == "\n" else SPACE if c.isspace() else WORD if c.isalnum() else OTHER
    return np.fromiter((kind(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)


def symbols_of(texts: Sequence[str]) -> np.ndarray:
    """The symbols of several texts in a row; the first character of a text begins a run."""
    size = sum(map(len, texts))
    out = np.empty(size, np.uint8)
    at = 0
    for text in texts:
        for part in (text[i : i + BLOCK] for i in range(0, len(text), BLOCK)):
            out[at : at + len(part)] = _classes()[np.frombuffer(part.encode("utf-32-le"), dtype="<u4")]
            at += len(part)
    first = np.ones(size, bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    first[starts[starts < size]] = True
    out[first & ((out == WORD) | (out == OTHER))] += 1
    return out


def cuts(texts: Sequence[str], draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of units of each text, and its two cuts in code points, chosen by the rows of ``draws``."""
    symbols, behind = UNITS[unit]
    matrix = WaveletMatrix(symbols_of(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    # Boundaries inside a text: those of the text's ends do not part units.
    low, high = (starts, starts + sizes - 1) if behind else (starts + 1, starts + sizes)
    filled = sizes > 0
    before = matrix.rank_of(symbols, np.where(filled, low, 0))
    n = np.where(filled, matrix.rank_of(symbols, np.where(filled, high, 0)) - before + 1, 0)
    chosen = np.sort(draws % (n[:, None] + 1), axis=1)
    places = np.where(chosen >= n[:, None], sizes[:, None], 0)
    inner = (chosen > 0) & (chosen < n[:, None])
    wanted = (before[:, None] + chosen - 1)[inner]
    places[inner] = matrix.select_of(symbols, wanted) + behind - np.repeat(starts, inner.sum(axis=1))
    return n, places


def _hashes(seed: int, key: int | None) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:16])


def _rows(keys: list[int | None], texts: list[str], template: Template) -> list[tuple]:
    drawn = [_hashes(template.seed, k) for k in keys]
    counts, places = cuts(texts, np.array([h[:2] for h in drawn], dtype=np.int64).reshape(-1, 2), template.unit)
    marks = (template.prefix, template.suffix, template.middle)
    out = []
    for text, n, (a, b), (_, _, whether, which) in zip(texts, counts.tolist(), places.tolist(), drawn, strict=True):
        if not text or whether % 100 >= template.rate or any(m in text for m in marks):
            out.append((n, "plain", None, None, text))
            continue
        prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
        form, parts = ("spm", (suffix, prefix, middle)) if which % 100 < template.spm else ("psm", (prefix, suffix, middle))
        out.append((n, form, a, b - a, "".join(parts)))
    return out


def _transformed(template: Template) -> Callable[[pa.Array, pa.Array], pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows, at = [], 0
        while at < len(texts):
            group, size, first = [], 0, at
            while at < len(texts) and (not group or size < BLOCK):
                group.append(texts[at].as_py() or "")
                size += len(group[-1])
                at += 1
            rows += _rows(keys.slice(first, at - first).to_pylist(), group, template)
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        done = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        give_back_memory()
        return done

    return run


def transform(docs: DataFrame, template: Template | None = None, column: str = "fim") -> DataFrame:
    """Adds a struct: n units, form, prefix_chars and middle_chars (null if plain), and the output text.

    Only ids and texts go to Python; every document is cut on its own, so there is no shuffle.
    """
    ship_package(docs.sparkSession)
    cut = F.arrow_udf(_transformed(template or Template()), _RESULT)
    return docs.withColumn(column, cut(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def restored(output: Column, form: Column, template: Template | None = None) -> Column:
    """The text that an output of a form was made from."""
    t = template or Template()
    place = lambda mark: F.locate(mark, output)
    between = lambda a, mark, b: F.substring(output, a + len(mark), b - a - len(mark))
    p, s, m = place(t.prefix), place(t.suffix), place(t.middle)
    end = F.length(output) + 1
    middle = between(m, t.middle, end)
    psm = F.concat(between(p, t.prefix, s), middle, between(s, t.suffix, m))
    spm = F.concat(between(p, t.prefix, m), middle, between(s, t.suffix, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and lengths, and the digests of its output and of the text restored from that."""
    docs = table(spark, sf_dir, "documents")
    name = free_name("fim", docs.columns)
    done = transform(docs.select("doc_id", "text"), column=name).select("doc_id", f"{name}.*")
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(ls)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (SELECT doc_id, t, n, h4, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": _SQL}


def queries() -> dict:
    return {"op13_fill_in_middle": op13_fill_in_middle}
