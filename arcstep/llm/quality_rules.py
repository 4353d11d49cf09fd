"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores one bit for each
failed rule beside the measurements, so a new policy version, or an ablation of
one rule, is bitwise arithmetic over the ledger and never reads a text again.

Defined results for odd input: a null or empty text has no words, so it fails
``few_words`` and ``no_stop_words``; a null ``doc_id`` keeps its row; equal rows get equal
ledger rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import WORD_SEPARATORS, free_name, give_back_memory, ship_package, table, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What a bullet line begins with.
BULLETS = "-*•"
#: Words in a repeat window.
WINDOW = 5

#: Common English words; fixed values of a widely published heuristic.
STOP_WORDS = frozenset("the be to of and that have with".split())

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_digits long, n_bullet_lines long, n_ellipsis_lines long, n_stop_words long"
)
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` holds; ``bit`` is its place in the mask."""

    name: str
    bit: int
    fails: str


#: Integer comparisons only, so that every engine agrees on the edge cases.
RULES: tuple[Rule, ...] = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("short_words", 2, "word_chars < 2 * n_words"),
    Rule("long_words", 3, "word_chars > 14 * n_words"),
    Rule("symbols", 4, "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", 5, "100 * n_dup_lines > 50 * n_lines"),
    Rule("digits", 6, "100 * n_digits > 30 * word_chars"),
    Rule("bullet_lines", 7, "100 * n_bullet_lines > 90 * n_lines"),
    Rule("ellipsis_lines", 8, "100 * n_ellipsis_lines > 30 * n_lines"),
    Rule("no_stop_words", 9, "n_stop_words < 2"),
    Rule("very_long", 10, "n_words > 100000"),
)

#: Versioned policies: the rules that reject a document. Never edit one in place; add a version.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols"),
    "v2": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"),
    "v3": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "digits", "bullet_lines", "ellipsis_lines", "very_long"),
    "english": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "digits", "bullet_lines", "ellipsis_lines", "no_stop_words", "very_long"),
}
DEFAULT_POLICY = "v2"

_STOPS = {w.encode() for x in STOP_WORDS for w in (x, x.capitalize(), x.upper())}
_MULTIPLIERS = np.array(
    [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64
)


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=len(words))
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        # Mixing each identifier first keeps sums of small numbers apart.
        x = (ids[k : k + n] + np.uint64(1)) * _MULTIPLIERS[k % WINDOW]
        x ^= x >> np.uint64(29)
        keys = (keys ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
    order = np.sort(keys)
    again = order[1:] == order[:-1]
    if not again.any():
        return 0
    starts = np.flatnonzero(np.isin(keys, np.unique(order[1:][again])))
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of ``MEASURES``; lines count if they have a word."""
    if not text:
        return (0,) * len(_NAMES)
    words = text.encode().split()  # bytes.split cuts at exactly the six ASCII separators
    chars = len(text) - sum(map(text.count, WORD_SEPARATORS))
    symbols, digits = sum(map(text.count, SYMBOLS)), sum(map(text.count, "0123456789"))
    lines = [x for x in text.split("\n") if x.strip(WORD_SEPARATORS)]
    bare = [x.strip(WORD_SEPARATORS) for x in lines]
    bullets = sum(x[0] in BULLETS for x in bare)
    ellipses = sum(x.endswith(("...", "…")) for x in bare)
    stops = sum(map(_STOPS.__contains__, words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words), len(lines), digits, bullets, ellipses, stops


def _measure_texts(texts: pa.Array) -> pa.Array:
    rows = (measure(x) for at in range(0, len(texts), 256) for x in texts.slice(at, 256).to_pylist())
    columns = np.fromiter((v for row in rows for v in row), dtype=np.int64).reshape(-1, len(_NAMES))
    give_back_memory()
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.T], _NAMES)


def _measured(docs: DataFrame) -> Column:
    """The measurements of ``text`` as a struct; only the texts go to Python."""
    ship_package(docs.sparkSession)
    fields = MEASURES.replace(" long", ": long")
    return F.arrow_udf(_measure_texts, f"struct<{fields}>")(F.col("text").cast("string"))


def mask_of(rules: tuple[Rule, ...] = RULES, struct: str | None = None) -> Column:
    """The failure bits as one BIGINT expression over the measurements, which may be fields of a struct."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        fails = rule.fails if struct is None else re.sub(r"\b(" + "|".join(_NAMES) + r")\b", rf"`{struct}`.\1", rule.fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def policy_mask(policy: str = DEFAULT_POLICY, rules: tuple[Rule, ...] = RULES) -> int:
    """The mask of the rules that a policy version enforces."""
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in POLICIES[policy])


def evaluate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger: doc_id, the measurements and ``failed``, the mask of failed rules."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _measured(docs).alias("m"))
    return measured.select("doc_id", "m.*").withColumn("failed", mask_of(rules))


def apply_policy(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version."""
    hit = lambda name: F.col("failed").bitwiseAND(F.lit(policy_mask(name))) != 0
    return ledger.withColumn("base_failed", hit("base")).withColumn("kept", ~(hit("base") | hit(policy)))


def ablations(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those it alone rejects.

    The ledger is first counted by enforced mask, at most 2 ** rules groups, so
    the per-rule sums read a handful of rows.
    """
    enforced = policy_mask(policy)
    groups = (
        ledger.select(F.col("failed").bitwiseAND(F.lit(enforced)).alias("m"))
        .groupBy("m")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rules = [r for r in RULES if enforced >> r.bit & 1]
    exploded = groups.select(
        "m", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])).alias("r")
    )
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return exploded.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("m").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("m") == F.col("r.bit")).alias("n_only"),
        total(F.col("m") == 0).alias("n_kept"),
        total((F.col("m") == 0) | (F.col("m") == F.col("r.bit"))).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents a policy keeps, with their own columns: the filter form of the ledger.

    Only the texts go to Python, and the measurements come back beside their rows
    in one pass, so no join and no shuffle is needed.
    """
    ledger = free_name("ledger", docs.columns)
    measured = docs.withColumn(ledger, _measured(docs))
    rejects = policy_mask("base") | policy_mask(policy)
    return measured.where(mask_of(struct=ledger).bitwiseAND(F.lit(rejects)) == 0).drop(ledger)


def store(docs: DataFrame) -> DataFrame:
    """The ledger, written once as a table in the shared folder: policies and ablations read it instead of texts."""
    return written(evaluate(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stored ledger row and the default policy's verdict."""
    return apply_policy(store(table(spark, sf_dir, "documents"))).select("doc_id", *_NAMES, "failed", "base_failed", "kept")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablation counts of the rules of every policy version, all from one stored ledger."""
    ledger = store(table(spark, sf_dir, "documents"))
    out = None
    for policy in POLICIES:
        one = ablations(ledger, policy).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


_LEDGER_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), lines AS (
  SELECT doc_id, line, count(*) AS c
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), dl AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum(c)::BIGINT AS n_lines,
         coalesce(sum(c) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')), 0)::BIGINT AS n_bullet_lines,
         coalesce(sum(c) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')), 0)::BIGINT AS n_ellipsis_lines
  FROM lines GROUP BY doc_id
), win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3))) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), rw AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words
  FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
         coalesce(n_bullet_lines, 0)::BIGINT AS n_bullet_lines, coalesce(n_ellipsis_lines, 0)::BIGINT AS n_ellipsis_lines,
         len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN dl ON dl.doc_id = w.doc_id LEFT JOIN rw ON rw.doc_id = w.doc_id
), led AS (
  SELECT *, ({bits})::BIGINT AS failed FROM m
)
"""


def _ledger_sql() -> str:
    bits = " + ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in RULES)
    stops = ", ".join(f"'{w.decode()}'" for w in sorted(_STOPS))
    return _LEDGER_SQL.replace("{bits}", bits).replace("{stops}", stops)


def oracle_sql() -> dict[str, str]:
    base, enforced = policy_mask("base"), policy_mask()
    per_rule = " UNION ALL ".join(
        f"SELECT '{policy}' AS policy, '{r.name}' AS rule, (count(*) FILTER (failed & {1 << r.bit} <> 0))::BIGINT AS n_failed,"
        f" (count(*) FILTER (failed & {mask} = {1 << r.bit}))::BIGINT AS n_only, (count(*) FILTER (failed & {mask} = 0))::BIGINT AS n_kept,"
        f" (count(*) FILTER (failed & {mask} IN (0, {1 << r.bit})))::BIGINT AS n_kept_without FROM led"
        for policy in POLICIES
        for mask in (policy_mask(policy),)
        for r in RULES
        if mask >> r.bit & 1
    )
    return {
        "op8_quality_rules": _ledger_sql()
        + f"SELECT *, (failed & {base}) <> 0 AS base_failed, (failed & {base | enforced}) = 0 AS kept FROM led",
        "quality_ablations": _ledger_sql() + per_rule,
    }


def queries() -> dict:
    return {"op8_quality_rules": op8_quality_rules, "quality_ablations": quality_ablations}
