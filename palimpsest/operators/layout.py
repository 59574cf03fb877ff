"""Layout blocks of pages: body font, running headers, headings and their levels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAME_PLACE, RUNNING, RUNNING_WORDS = 0.5, 0.3, 5
LARGE, LARGE_IF_BOLD = 1.5, 1.2


def body_fonts(blocks: DataFrame) -> DataFrame:
    """Of each document the font size with most characters, and the font with most of those; ties: smaller size, then name."""
    d = blocks.groupBy("doc_id", "font_size", "font_name").agg(F.sum(F.length("text")).alias("chars"))
    sizes = d.groupBy("doc_id", "font_size").agg(F.sum("chars").alias("chars"), F.min(F.struct((-F.col("chars")).alias("n"), "font_name")).alias("f"))
    top = sizes.groupBy("doc_id").agg(F.min(F.struct((-F.col("chars")).alias("n"), "font_size", "f")).alias("t"))
    return top.select("doc_id", F.col("t.font_size").alias("body_size"), F.col("t.f.font_name").alias("body_font"), (-F.col("t.n")).alias("body_chars"))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b]+", " "))


def noise_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, why): texts on more than half of the pages at one height, and short capital ones on more than 0.3 of them.

    Pages are counted from one pre-aggregated row for each text, height and page, so a frequent text is no hot group.
    """
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    d = blocks.select("doc_id", plain(F.col("text")).alias("text"), F.bround(F.col("y0") / 5).cast("long").alias("band"), "page").distinct()
    key = F.lower("text").alias("key")
    at = d.groupBy("doc_id", key, "band").agg(F.countDistinct("page").alias("n")).groupBy("doc_id", "key").agg(F.max("n").alias("n")).withColumn("share", F.lit(SAME_PLACE)).withColumn("why", F.lit("header"))
    capital = d.where((F.col("text") == F.upper("text")) & (F.size(F.split("text", " ")) <= RUNNING_WORDS))
    running = capital.groupBy("doc_id", "text").agg(F.countDistinct("page").alias("n")).groupBy("doc_id", key).agg(F.max("n").alias("n")).withColumn("share", F.lit(RUNNING)).withColumn("why", F.lit("running"))
    return at.unionByName(running).join(pages, "doc_id").where(F.col("n") > F.col("share") * F.col("n_pages")).select("doc_id", "key", "why", "n")


#: How headings of chapters and sections begin.
CHAPTERS = r"^(?:(?i:chapter|part)\s+[0-9]+|[0-9]+\.\s+[\p{L}\p{N}_]|[0-9]+\s+[A-Z]|[IVXLC]+\.\s+[\p{L}\p{N}_]|(?i:introduction|conclusion|preface|foreword|epilogue|prologue|appendix)\b)"


def centered(x0: Column, x1: Column, width: Column, tolerance: float = 0.15) -> Column:
    """A block of up to three quarters of the page's width whose middle is near the page's."""
    return F.coalesce((width > 0) & ((x1 - x0) / width <= 0.75) & (F.abs((x0 + x1) / 2 - width / 2) / width < tolerance), F.lit(False))


def heading_candidates(blocks: DataFrame, fonts: DataFrame) -> DataFrame:
    """Blocks of 3 to 120 characters that are large, bold and larger than the body, or named as chapters; with their confidence in hundredths."""
    ratio, chapter = F.when(F.col("body_size") > 0, F.col("font_size") / F.col("body_size")).otherwise(0.0), F.trim("text").rlike(CHAPTERS)
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    d = blocks.join(fonts, "doc_id").withColumns({"ratio": ratio, "chapter": chapter})
    d = d.where(F.length(F.trim("text")).between(3, 120) & ((F.col("ratio") >= LARGE) | (F.col("is_bold") & (F.col("ratio") >= LARGE_IF_BOLD)) | F.col("chapter")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    sure = 30 + points(F.col("ratio") >= LARGE, 30) + points(F.col("is_bold"), 20) + points(F.col("chapter"), 30) + points(centered(F.col("x0"), F.col("x1"), F.col("page_width")), 10) + points(words <= 10, 10)
    return d.withColumn("confidence", F.least(F.lit(99), sure).cast("long"))


def heading_levels(headings: DataFrame) -> DataFrame:
    """Level 1: the document's largest size, or a chapter's name; 2: the second size, or bold two points above the body; 3: the third, or bold at its size; else 2."""
    sizes = headings.select("doc_id", "font_size").distinct()
    ranked = sizes.withColumn("_rank", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc("font_size"))))
    near = lambda to: F.col("is_bold") & (F.abs(F.col("font_size") - to) < 0.6)
    level = F.when((F.col("_rank") == 1) | F.col("chapter"), 1).when((F.col("_rank") == 2) | near(F.col("body_size") + 2), 2).when((F.col("_rank") == 3) | near(F.col("body_size")), 3).otherwise(2)
    return headings.join(ranked, ["doc_id", "font_size"]).withColumn("level", level).drop("_rank")


def dedup_key(text: Column) -> Column:
    """A heading's text without its number, in lower case, white space as one."""
    bare = F.trim(text)
    for lead in (r"(?i)^(?:chapter|part|section)\s+[0-9ivxlc]+[.:)]*\s*", r"^[0-9]+[.:)]\s*", r"^[IVXLC]+[.:)]\s*"):
        bare = F.regexp_replace(bare, lead, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def without_twin(headings: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Headings whose key no known one of the same document has."""
    d = headings.withColumn("_k", dedup_key(F.col("text")))
    return d.join(known.select(*keys, dedup_key(F.col("text")).alias("_k")).distinct(), [*keys, "_k"], "left_anti").drop("_k")


def footnote(height: Column, size_ratio: Column) -> Column:
    """A block low on its page (share of its height from below) in smaller type is a footnote."""
    return ((height <= 0.15) & (size_ratio < 0.95)) | ((height <= 0.40) & (size_ratio < 0.85))


def demoted(toc: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Levels of a flat table of contents: of more than `most` entries all at the first level, all go to the second."""
    flat = toc.groupBy(key).agg((F.bool_and(F.col("level") == 1) & (F.count(F.lit(1)) > most)).alias("_flat"))
    return toc.join(flat, key).withColumn("level", F.when(F.col("_flat"), 2).otherwise(F.col("level"))).drop("_flat")
