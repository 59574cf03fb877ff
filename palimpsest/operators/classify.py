"""Failure patterns, status, and what they share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import penalties, segment_score


def detect_issues(patterns: dict[str, tuple[Column, str]]) -> Column:
    """Array of (pattern, severity); a predicate that is null counts as false."""
    return F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"))) for name, (p, severity) in patterns.items())))


def status(issues: Column, failed: Column) -> Column:
    has = lambda s: F.exists(issues, lambda x: x["severity"] == s)
    return F.when(failed, "ERROR").when(has("critical"), "FAIL").when(has("high"), "WARN").otherwise("PASS")


def text_quality(docs: DataFrame) -> DataFrame:
    """Counts, score, issues and status of each document's text, in one pass."""
    d = docs.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), *(c.alias(n) for n, c in penalties(F.col("text")).items()))
    d = d.withColumn("score", segment_score(F.col("n_replaced"), F.col("n_ligatures"), F.col("n_doubles"), F.col("n_controls"), F.col("n_chars")))
    words, score = F.col("n_words"), F.col("score")
    patterns = {"LIGATURE_SPLITS_HIGH": (F.col("n_ligatures") > 20, "medium"), "DOUBLE_SPACES": (F.col("n_doubles") > 20, "low"), "LIKELY_SCAN_NO_OCR": (words < 100, "medium"), "TEXT_LAYER_LOW_QUALITY": ((score < 50) & (words > 100), "high"), "TEXT_LAYER_BORDERLINE": ((score >= 50) & (score < 75) & (words > 100), "medium")}
    d = d.withColumn("issues", detect_issues(patterns))
    return d.withColumn("status", status(F.col("issues"), F.lit(False)))


def quality_by_source(docs: DataFrame) -> DataFrame:
    """Documents by source: how many pass and warn, and how many have each pattern."""
    d = text_quality(docs)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has = lambda p: n(F.exists("issues", lambda x: x["pattern"] == p))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), n(F.col("status") == "PASS").alias("n_pass"), n(F.col("status") == "WARN").alias("n_warn"), has("LIGATURE_SPLITS_HIGH").alias("n_ligature"), has("DOUBLE_SPACES").alias("n_double"), has("LIKELY_SCAN_NO_OCR").alias("n_short"), has("TEXT_LAYER_LOW_QUALITY").alias("n_low"), has("TEXT_LAYER_BORDERLINE").alias("n_borderline"), F.sum("n_words").alias("n_words"))


#: Characters by which a line is taken for program code.
CODE = "[{}();=]"


def repeated_lines(blocks: DataFrame, least_pages: int = 5, density: float = 0.1, low: int = 15, high: int = 150) -> DataFrame:
    """Running headers: texts of low to high characters, not code, on `least_pages` pages and that share of the document's pages or more. A text counts once a page before it is shuffled."""
    lines = blocks.where(F.length("text").between(low, high) & ~F.col("text").rlike(CODE)).select("doc_id", "page", "text").distinct()
    pages = blocks.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("page").alias("n_pages"))
    met = lines.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    return met.join(pages, "doc_id").where(F.col("n") >= density * F.col("n_pages")).select("doc_id", "text", "n")
