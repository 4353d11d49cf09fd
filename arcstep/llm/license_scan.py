"""License scans: Dice coefficient over word bigrams between normalised text and licence templates.

Texts are lower-cased and reduced to words of letters and digits. The units that
are compared are every line, every paragraph of two lines or more (lines with a
word, between blank lines) and the whole text where it has two paragraphs or
more. Two sets of bigrams A and B have Dice coefficient 2|A&B| / (|A|+|B|), which
cannot reach t unless t/(2-t) |A| <= |B| <= (2-t)/t |A|, so these bounds choose
the templates that are compared at all. The template list is a fixed parameter,
small by nature.

Defined results for odd input: a null or empty text, or one without two words in
a row, matches nothing; a null doc_id keeps its matches; repeated rows repeat
their matches; each licence that reaches the threshold is a row of its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import map_batches, table

#: Least coefficient of a match, as a fraction of whole numbers.
THRESHOLD = (8, 10)

#: Notices by which public licences are applied to a work.
TEMPLATES: Mapping[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PARAGRAPH = regex.compile(r"\n[\x20\x09-\x0D]*\n")


def words_of(text: str) -> list[str]:
    """The normalised words of a text."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Templates:
    """Templates by the size of their bigram set, with an index from bigram to templates."""

    def __init__(self, texts: Mapping[str, str], threshold: tuple[int, int] = THRESHOLD) -> None:
        rows = sorted((len(b), name, b) for name, text in texts.items() if (b := bigrams(words_of(text))))
        self.sizes = [n for n, _, _ in rows]
        self.names = [name for _, name, _ in rows]
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, own) in enumerate(rows):
            for x in own:
                self.index.setdefault(x, []).append(k)
        self.over, self.under = threshold
        # Sizes of a unit that can match any template.
        wide = 2 * self.under - self.over
        self.least = -(-self.over * self.sizes[0] // wide) if rows else 1
        self.most = wide * self.sizes[-1] // self.over if rows else 0

    def matches(self, words: list[str]) -> Iterator[tuple[str, int, int, int]]:
        """(template, shared bigrams, unit's bigrams, template's bigrams) at or over the threshold."""
        if len(words) <= self.least:
            return
        own = bigrams(words)
        n, wide = len(own), 2 * self.under - self.over
        if not self.least <= n <= self.most:
            return
        low = bisect_left(self.sizes, -(-self.over * n // wide))
        high = bisect_right(self.sizes, wide * n // self.over)
        shared = Counter(k for x in own for k in self.index.get(x, ()) if low <= k < high)
        for k, both in sorted(shared.items()):
            if 2 * both * self.under >= self.over * (n + self.sizes[k]):
                yield self.names[k], both, n, self.sizes[k]

    def scan(self, text: str | None) -> Iterator[tuple[str, int, str, int, int, int]]:
        """(kind, place, template, shared, unit's size, template's size) over all units of a text."""
        if not text:
            return
        lines = [words_of(x) for x in text.split("\n")]
        for i, words in enumerate(lines):
            yield from (("line", i, *m) for m in self.matches(words))
        parts = _PARAGRAPH.split(text)
        for i, part in enumerate(parts):
            if "\n" in part:
                yield from (("paragraph", i, *m) for m in self.matches(words_of(part)))
        if len(parts) > 1:
            yield from (("text", 0, *m) for m in self.matches([w for words in lines for w in words]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """A row for each match: doc_id, kind, place, license, shared, unit_size, template_size and dice."""
    texts = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        names = ["doc_id", "kind", "place", "license", "shared", "unit_size", "template_size"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [(i, *m) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in known.scan(t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    found = map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        run,
        "doc_id long, kind string, place long, license string, shared long, unit_size long, template_size long",
    )
    return found.withColumn("dice", F.round(2 * F.col("shared") / (F.col("unit_size") + F.col("template_size")), 6))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licence matches of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql() -> dict[str, str]:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = lambda x: f"list_distinct(list_transform(range(1, greatest(1, len({x}))), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    over, under = THRESHOLD
    return {
        "op10_license_scan": rf"""
WITH t AS (SELECT name, {grams('w')} AS g FROM (SELECT name, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {rows}) v(name, x))),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, string_split_regex(text, '\n[\x20\x09-\x0D]*\n') AS ps FROM documents WHERE text <> ''),
u AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(ls))) AS place, unnest(ls) AS x FROM l
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) AS x FROM l) WHERE contains(x, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM l WHERE len(ps) > 1
),
w AS (SELECT doc_id, kind, place, {grams('w')} AS g FROM (SELECT *, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM u) WHERE len(w) >= 2),
m AS (SELECT doc_id, kind, place, name AS license, len(list_intersect(w.g, t.g))::BIGINT AS shared, len(w.g)::BIGINT AS unit_size, len(t.g)::BIGINT AS template_size
      FROM w JOIN t ON len(w.g) * {over} <= (2 * {under} - {over}) * len(t.g) AND len(t.g) * {over} <= (2 * {under} - {over}) * len(w.g))
SELECT doc_id, kind, place::BIGINT AS place, license, shared, unit_size, template_size, round(2 * shared / (unit_size + template_size), 6) AS dice
FROM m WHERE 2 * shared * {under} >= {over} * (unit_size + template_size)"""
    }


def queries() -> dict:
    return {"op10_license_scan": op10_license_scan}
