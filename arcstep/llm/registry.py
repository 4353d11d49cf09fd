"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from arcstep.llm import bpe, chat_format, embedding_dedup, fill_in_middle, html_extract, license_scan, line_dedup, lm_score, ngram_join, packing, quality_rules, spelling_variants, url_filter

MODULES = (bpe, chat_format, embedding_dedup, fill_in_middle, html_extract, license_scan, line_dedup, lm_score, ngram_join, packing, quality_rules, spelling_variants, url_filter)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.oracle_sql()
    return found
