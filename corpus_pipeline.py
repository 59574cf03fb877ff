"""Five stages from documents to packed sequences; each works on all that the one before it kept.

Null and empty texts fail the quality rules. Repeated rows are judged alike there; of equal texts one row stays, that of the least
doc_id, null last. A row without a doc_id has no say in whose copy another is, and stays if its text is no exact copy. Very long texts go through
whole. Other columns, whatever their names, pass unchanged through all stages but the last; n_chars follows the text. An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, near_copies, packing, pii, quality_rules
from palimpsest.llm.common import load, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; frequent lines go from the others' texts."""
    return quality_rules.apply_quality_rules(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; even doc_ids are the history that the index holds."""
    return exact_dedup.drop_exact_copies(docs, F.col("doc_id") % 2 == 0)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays."""
    return near_copies.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to their kinds."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]

#: Redaction by boosted trees and packing are beyond SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
