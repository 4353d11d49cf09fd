"""The corpus pipeline: quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that the one
before kept; all but the last return the columns of ``documents``, whatever other
columns there are and however they are named. ``text`` and, after line dedup,
``n_chars`` follow the decisions.

Defined results for odd input, in every stage: an empty table gives no rows; a
null text counts as empty, and fails the quality rules as having few words; a null
doc_id keeps its row and comes first in line dedup, last among near duplicates;
rows are told apart by doc_id and text, so that of rows equal in both one stays in
the third stage, while rows of one doc_id with different texts are judged each by
its own text; texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm import bpe, line_dedup, ngram_join, packing, quality_rules
from arcstep.llm.common import checkpoint, free_name

#: SQL has no tokenizer, so the pipeline's rows are tested against a brute-force version.
ORACLE_SQL = None
#: A document that loses more than this share of its words as repeats of others is a near copy; its rest goes, too.
LEAST_LOST = 0.5


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy of the quality rules keeps."""
    return quality_rules.keep_good(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated runs of lines and words; those that lose every line, or most of their words, go."""
    name = free_name("dedup", docs.columns)
    done = line_dedup.dedup_text(docs, column=name)
    lost = F.col(name)["removed_words"] > LEAST_LOST * F.col(name)["n_words"]
    kept = done.where((F.col(name)["n_lines"] == 0) | ((F.col(name)["n_removed"] < F.col(name)["n_lines"]) & ~lost)).drop(name)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents kept."""
    return packing.pack(docs, bpe.vocabulary_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard_join", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
