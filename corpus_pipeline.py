"""Curation of ``documents`` into training sequences: quality, lines, near-duplicates, packing.

Each stage takes nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns; what it does with them is in its operator's
docstring: ``quality.keep_good``, ``lines.dedup_lines``, ``simhash.keep_one`` and
``packing.pack``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import lines, packing, quality, simhash
from sievelake.session import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or lie outside their compression bands go, null and empty texts among them."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay at their first place only; all documents stay, a null source is no site."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id, null ids last."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, cut into power-of-two sequences; rows with null ids are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("packing", pack)]

#: SQL has neither zstandard, fingerprint tiles nor the tokenizer: tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
